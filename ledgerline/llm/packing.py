"""Lexical retrieval packing of documents into fixed windows of tokens.

Documents are dealt to shards of bounded text by a hash of id and text. Each shard builds a BM25
inverted index over its token ids. A window starts with a seed document (what is left of the
document cut last, else the smallest unused id); the index returns unused neighbours of the
seed, best first, which fill the window in that order. The last one is cut where the window
ends and seeds the next. Only the last window of a shard can be short.

Defined cases: a null or empty text is the end id alone; equal scores go by id; repeated rows are
packed once each; an empty table gives no rows; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import tokens
from .common import n_bytes, parts_for, trim

#: Bytes of text in a shard, on average.
SHARD_BYTES = 4 << 20
K1, B = 1.2, 0.75

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Index:
    """BM25 postings of a shard: `terms` of all documents one after another, `sizes` of each."""

    def __init__(self, terms: np.ndarray, sizes: np.ndarray):
        self.n = len(sizes)
        vocab = int(terms.max()) + 1 if len(terms) else 1
        owner = np.repeat(np.arange(self.n, dtype=np.int64), sizes)
        pairs = np.sort(terms.astype(np.int64) * self.n + owner)
        first = np.flatnonzero(np.diff(pairs, prepend=-1))
        tf = np.diff(np.append(first, len(pairs)))
        self.term, self.doc = np.divmod(pairs[first], self.n)
        df = np.bincount(self.term, minlength=vocab)
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * sizes / max(1.0, sizes.mean() if self.n else 1.0))
        self.weight = idf[self.term] * tf * (K1 + 1) / (tf + norm[self.doc])
        self.vocab = vocab
        self._first()
        by_doc = np.argsort(self.doc, kind="stable")
        starts = np.searchsorted(self.doc[by_doc], np.arange(self.n + 1))
        self.query = [self.term[by_doc[a:b]] for a, b in zip(starts[:-1], starts[1:], strict=True)]

    def _first(self) -> None:
        self.first = np.concatenate([[0], np.cumsum(np.bincount(self.term, minlength=self.vocab))])

    def without(self, used: np.ndarray) -> None:
        """Drop the postings of used documents; the weights of the others stay."""
        kept = ~used[self.doc]
        self.term, self.doc, self.weight = self.term[kept], self.doc[kept], self.weight[kept]
        self._first()

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document that has postings, for all distinct terms of the seed."""
        terms = self.query[seed]
        first, sizes = self.first[terms], self.first[terms + 1] - self.first[terms]
        ends = np.cumsum(sizes)
        at = np.repeat(first - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)
        return np.bincount(self.doc[at], self.weight[at], self.n)


def fill(index: Index, sizes: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that fill windows greedily."""
    out, n = [], len(sizes)
    used = np.zeros(n, bool)
    sequence, offset, after, carry, done, pruned = 0, 0, 0, -1, 0, n

    def place(d: int, start: int) -> int:
        """Put what fits of the document; returns where it was cut, or -1."""
        nonlocal sequence, offset
        length = int(min(window - offset, sizes[d] - start))
        out.append((d, start, length, sequence, offset))
        offset += length
        if offset == window:
            sequence, offset = sequence + 1, 0
        return start + length if start + length < sizes[d] else -1

    while True:
        if carry >= 0:
            seed, start = carry, after
        else:
            while done < n and used[done]:
                done += 1
            if done == n:
                return out
            seed, start = done, 0
            used[seed] = True
        after = place(seed, start)
        carry = seed if after >= 0 else -1
        if carry >= 0 or offset == 0:
            continue
        left = np.flatnonzero(~used)
        if len(left) < 0.8 * pruned:
            index.without(used)
            pruned = len(left)
        scores = index.scores(seed)[left]
        most = min(len(left), 64)
        # the best few first, then everything, should those not fill the window
        for best in (left[np.argpartition(-scores, most - 1)[:most]] if most < len(left) else left, left):
            order = best[np.lexsort((best, -scores[np.searchsorted(left, best)]))]
            for d in order:
                if used[d]:
                    continue
                used[d] = True
                after = place(int(d), 0)
                carry = int(d) if after >= 0 else -1
                if offset == 0:
                    break
            if offset == 0 or len(best) == len(left):
                break


def pack(docs: DataFrame, tokenizer_file: str, window: int = 4096, end_id: int = 2, shard_bytes: int = SHARD_BYTES, with_ids: bool = False) -> DataFrame:
    """Every piece of every document: its place in the document and in its sequence.

    `with_ids` adds the piece's ids as little-endian unsigned 32-bit integers.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    shards = parts_for(n_bytes(docs), shard_bytes)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        texts = [t or "" for t in rows.column("text").to_pylist()]
        ids, sizes = tokens.piece_table(tokenizer_file, spaced=False, limit=100_000).encode(texts)
        del texts
        ends = np.cumsum(sizes)
        index = Index(ids, sizes)
        ids = np.insert(ids, ends, end_id).astype("<u4")
        sizes = sizes + 1
        first = np.cumsum(sizes) - sizes
        pieces = fill(index, sizes, window)
        doc, start, length, sequence, offset = (np.asarray(x, np.int64) for x in (zip(*pieces, strict=True) if pieces else [()] * 5))
        begin = first[doc] + start
        blobs = [ids[a : a + n].tobytes() for a, n in zip(begin, length, strict=True)]
        out = {
            "doc_id": rows.column("doc_id").combine_chunks().take(pa.array(doc)),
            "start": start,
            "length": length,
            "ids_crc32": np.asarray([zlib.crc32(x) for x in blobs], np.int64),
            "doc_tokens": sizes[doc],
            "sequence_id": (np.int64(key[0].as_py()) << 32) + sequence,
            "offset": offset,
        }
        if with_ids:
            out["ids"] = pa.array(blobs, pa.binary())
        trim()
        return pa.table(out)

    schema = PIECES + ", ids binary" * with_ids
    return docs.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(shards))).groupBy("shard").applyInArrow(
        lambda key, rows: run(key, rows.drop_columns(["shard"])), schema
    )
