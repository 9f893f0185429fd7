"""Byte-level BPE encoding and decoding with a local rank file.

Every text is encoded whole: texts beyond a segment are pre-split where the pattern must start a
new match, so the ids equal those of one call over the whole text. Decoding joins raw bytes.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows are
independent; columns other than the two named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from .common import small_batches, texts_of


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), n_tokens for every row of `docs`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokens.rank_encoding(rank_file, pattern)
        for batch in small_batches(batches):
            ids = [tokens.rank_ids(encoding, t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([len(x) for x in ids], pa.int64())],
                ["doc_id", "ids", "n_tokens"],
            )

    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, ids binary, n_tokens long")


def decode_bytes(ids: bytes, rank_file: str, pattern: str) -> bytes:
    """The bytes that ids stand for; ids beyond the file raise KeyError."""
    import numpy as np

    return tokens.rank_encoding(rank_file, pattern).decode_bytes(np.frombuffer(ids, "<u4").tolist())


def round_trip(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_tokens, SHA-256 of its ids and of the bytes that these decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = tokens.rank_encoding(rank_file, pattern)
        for batch in small_batches(batches):
            n, own, back = [], [], []
            for t in texts_of(batch):
                ids = tokens.rank_ids(encoding, t)
                n.append(len(ids))
                own.append(hashlib.sha256(ids.tobytes()).hexdigest())
                back.append(hashlib.sha256(encoding.decode_bytes(ids.tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(own), pa.array(back)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
