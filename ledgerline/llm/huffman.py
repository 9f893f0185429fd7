"""Token-ID output: canonical length-limited Huffman coding of ids from global counts.

File format (a folder of two Parquet tables, so that writing commits and reading scales as Spark's
own files do):

* `codebook`: one row, `lengths` = the code length in bits of every id from 0 on (one byte each,
  0: the id does not occur). Codes are canonical: ordered by (length, id).
* `blocks`: `part`, `block`, `part_start` (ids of the part before the block),
  `n_ids`, `doc_ids` (int64), `without_id` (how many of the first of them are null; 0 stands there),
  `sizes` (int64, ids of each document), `payload` (codes, most significant bit first, padded to
  32-bit words) and `marks` (int64, the bit offset of every MARK-th id). All little-endian, except
  that payload words are big-endian. Parts and blocks are in ascending document order, and a block
  holds whole documents, so it decodes alone; marks let its stretches decode side by side.

Defined cases: a null or empty text is its end id alone; repeated rows are written once each,
ordered by id and a hash of the content, those of a null id first; an empty table gives an empty file; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import tokens
from .common import parts_for, small_batches, stored, texts_of, trimmed

#: No code is longer than this many bits.
MAX_BITS = 20
#: Ids between two marks, and ids after which a block ends.
MARK, BLOCK = 1024, 1 << 17
BLOCKS = "part int, block int, part_start long, n_ids long, without_id long, doc_ids binary, sizes binary, payload binary, marks binary"


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most `max_bits`, by package-merge; 0 for symbols that do not occur."""
    out = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n < 2:
        out[used] = 1
        return out
    if n > 1 << max_bits:
        raise ValueError(f"{n} symbols need codes of more than {max_bits} bits")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    rows, leaf = weights, [np.ones(n, bool)]
    for _ in range(max_bits - 1):
        packages = rows[: len(rows) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, packages])
        order = np.argsort(both, kind="stable")
        rows = both[order]
        leaf.append(order < n)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for is_leaf in reversed(leaf):
        own = int(is_leaf[:take].sum())
        lengths[:own] += 1
        take = 2 * (take - own)
    out[used] = lengths
    return out


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol, in the low bits of a uint32."""
    codes = np.zeros(len(lengths), np.uint32)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        top = int(lengths.max())
        spans = np.uint64(1) << (np.uint64(top) - lengths[order].astype(np.uint64))
        starts = np.cumsum(spans) - spans
        codes[order] = (starts >> (np.uint64(top) - lengths[order].astype(np.uint64))).astype(np.uint32)
    return codes


def encode_block(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Payload of the ids, and the bit offset of every MARK-th of them."""
    if not len(ids):
        return b"", np.zeros(0, np.int64)
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    at = ends - size
    word = at >> 5
    value = codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    out = np.zeros(int(ends[-1] >> 5) + 3, np.uint64)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    out[word[first]] += np.add.reduceat(value >> np.uint64(32), first)
    out[word[first] + 1] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    return out.astype(">u4").tobytes(), at[::MARK]


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """For every value of the next `bits` bits: the symbol they begin with, and its length."""
    bits = max(1, int(lengths.max(initial=0)))
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    spans = 1 << (bits - lengths[order].astype(np.int64))
    symbols, sizes = np.repeat(order, spans).astype(np.uint32), np.repeat(lengths[order], spans)
    pad = (1 << bits) - len(symbols)
    return np.pad(symbols, (0, pad)), np.pad(sizes, (0, pad)), bits


def decode_blocks(payloads: list[bytes], marks: list[np.ndarray], totals: list[int], table: tuple) -> list[np.ndarray]:
    """Ids of each block. All stretches between marks of all blocks advance together, one id a step."""
    symbols, sizes, bits = table
    joined = np.frombuffer(b"".join(payloads) + b"\0" * 8, np.uint8).astype(np.uint32)
    view = (joined[:-3] << 24) | (joined[1:-2] << 16) | (joined[2:-1] << 8) | joined[3:]
    base = np.cumsum([0, *map(len, payloads)])[:-1] * 8
    at = np.concatenate([m + b for m, b in zip(marks, base, strict=True)] or [np.zeros(0, np.int64)])
    lanes = [np.minimum(MARK, n - np.arange(len(m)) * MARK) for m, n in zip(marks, totals, strict=True)]
    count = np.concatenate(lanes or [np.zeros(0, np.int64)])
    by_size = np.argsort(-count, kind="stable")
    at, left = at[by_size], count[by_size]
    out = np.zeros((MARK, len(at)), np.uint32)
    live = len(at)
    for step in range(int(left[0]) if len(left) else 0):
        while live and left[live - 1] <= step:
            live -= 1
        p = at[:live]
        peek = (view[p >> 3] << (p & 7).astype(np.uint32)) >> np.uint32(32 - bits)
        out[step, :live] = symbols[peek]
        at[:live] = p + sizes[peek]
    back = np.argsort(by_size)
    rows = out.T[back]
    ends = np.cumsum([0, *map(len, marks)])
    return [rows[a:b].reshape(-1)[:n] if b > a else np.zeros(0, np.uint32) for a, b, n in zip(ends[:-1], ends[1:], totals, strict=True)]


def token_table(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """doc_id and ids (binary; `width` bytes each: two where the vocabulary allows, else four) of every
    row; and rows without ids, but with counts of the ids of the rows before, as 64-bit integers."""
    vocab = vocabulary(tokenizer_file, end_id)
    width = 2 if vocab <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = tokens.piece_table(tokenizer_file, spaced=True)
        names, counts = ["doc_id", "ids", "counts"], np.zeros(vocab, np.int64)
        for batch in small_batches(batches):
            ids, sizes = pieces.encode(texts_of(batch))
            ends = np.cumsum(sizes + 1)
            flat = np.full(int(ends[-1]), end_id, f"<u{width}")
            inside = np.ones(len(flat), bool)
            inside[ends - 1] = False
            flat[inside] = ids
            counts += np.bincount(flat, minlength=vocab)
            raw = flat.tobytes()
            blobs = [raw[width * a : width * b] for a, b in zip(ends - sizes - 1, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(blobs, pa.binary()), pa.nulls(len(blobs), pa.binary())], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(trimmed(run), "doc_id long, ids binary, counts binary")
    return out.withColumns({"width": F.lit(width), "content": F.xxhash64("ids")})


def vocabulary(tokenizer_file: str, end_id: int) -> int:
    return max(tokens.piece_table(tokenizer_file, spaced=True).tokenizer.get_vocab_size(), end_id + 1)


def id_counts(table: DataFrame, vocab: int) -> np.ndarray:
    """How often each id occurs, from the counts of the tasks; the driver gets one number for each id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(vocab, np.int64)
        for batch in batches:
            for blob in batch.column("counts").to_pylist():
                counts += np.frombuffer(blob, np.int64)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], ["id", "n"])

    out = np.zeros(vocab, np.int64)
    for row in table.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[row.id] = row.n
    return out


def write(docs: DataFrame, path: str, tokenizer_file: str, end_id: int = 0, part_bytes: int = 16 << 20) -> None:
    """Encode every text and write the file, documents in ascending id order."""
    spark = docs.sparkSession
    table = stored(token_table(docs, tokenizer_file, end_id), "ids")
    counts = id_counts(table, vocabulary(tokenizer_file, end_id))
    lengths = code_lengths(counts)
    codes = canonical_codes(lengths)
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{path}/codebook")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block, before = TaskContext.get().partitionId(), 0, 0
        ids, docs_, sizes, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            payload, marks = encode_block(np.concatenate(ids), codes, lengths)
            absent = sum(d is None for d in docs_)  # nulls come first
            values = [part, block, before, held, absent, np.asarray([0] * absent + docs_[absent:], "<i8").tobytes(), np.asarray(sizes, "<i8").tobytes(), payload, marks.astype("<i8").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * 4
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], [x.split()[0] for x in BLOCKS.split(", ")])

        for batch in batches:
            for doc, blob, width in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "width")), strict=True):
                own = np.frombuffer(blob, f"<u{width}")
                ids.append(own)
                docs_.append(doc)
                sizes.append(len(own))
                held += len(own)
                if held >= BLOCK:
                    yield row()
                    ids, docs_, sizes, block, before, held = [], [], [], block + 1, before + held, 0
        if ids:
            yield row()

    parts = parts_for(2 * int(counts.sum()), part_bytes)
    # The hash orders the rows of one id, so that these need not be in one part.
    table = table.where("ids is not null").select("doc_id", "ids", "width", "content")
    table.repartitionByRange(parts, "doc_id", "content").sortWithinPartitions("doc_id", "content").mapInArrow(run, BLOCKS).write.parquet(f"{path}/blocks")


def read(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """Per document of the file: doc_id, start (ids before it), n_tokens and the CRC-32 of its ids."""
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}/codebook").first().lengths), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decode_table(lengths)
        for batch in small_batches(batches, "payload", 4 << 20):
            get = lambda c, kind: [np.frombuffer(x, kind) for x in batch.column(c).to_pylist()]  # noqa: B023, E731
            doc_ids, sizes, marks = get("doc_ids", "<i8"), get("sizes", "<i8"), get("marks", "<i8")
            decoded = decode_blocks(batch.column("payload").to_pylist(), marks, [int(s.sum()) for s in sizes], table)
            for part, before, absent, docs_, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "part_start", "without_id")), doc_ids, sizes, decoded, strict=True):
                ends = np.cumsum(n)
                raw = ids.astype("<u4").tobytes()
                blobs = [raw[4 * a : 4 * b] for a, b in zip(ends - n, ends, strict=True)]
                cols = [pa.array(docs_, mask=np.arange(len(n)) < absent), pa.array(np.full(len(n), part, np.int32)), pa.array(before + ends - n), pa.array(n), pa.array([zlib.crc32(x) for x in blobs], pa.int64())]
                names = ["doc_id", "part", "in_part", "n_tokens", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(cols + [pa.array(blobs, pa.binary())] * with_ids, names + ["ids"] * with_ids)

    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    rows = blocks.mapInArrow(run, "doc_id long, part int, in_part long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)
    # One row for each part of the file: their running total has as many rows as the file has parts.
    sizes = blocks.groupBy("part").agg(F.sum("n_ids").alias("held"))
    starts = sizes.select("part", (F.sum("held").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))).alias("part_total"))
    out = rows.join(starts, "part").withColumn("start", F.coalesce("part_total", F.lit(0)) + F.col("in_part"))
    return out.select("doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids)
