"""Exact substring dedup: removal of every byte that a repeated string of `length` bytes covers.

1. Anchors. Of the grams in each window of `length` bytes, the one with the least hash is its anchor,
   so equal windows have equal anchors at equal places. Consecutive windows share anchors: a text
   becomes segments, each the stretch of the windows of one anchor. Windows whose anchor occurs once
   in the corpus occur once; this is exact and sets most text aside by a few bytes for each segment.
2. Among the segments of an anchor that occurs again, equal ones repeat as a whole. Different ones can
   share some of their windows; one text of each is cut out and goes to the shard of its anchor.
3. Shards. The suffix array of a shard's segments is built by Larsson-Sadakane refinement (sorted by
   the first eight bytes, then groups of equal rank alone are sorted by the rank of what follows
   them, at twice the depth each time), common prefixes of neighbours by Kasai's method, all
   segments in step. Windows whose common prefix with a neighbour reaches `length` repeat.
4. Where an anchor's segments exceed a shard, they are dealt over several; each hands its windows,
   one of each content, in the order of their fingerprints to range tasks, where every shard's list
   is searched in the others' by binary search.

Segment equality in (2) and window equality in (4) are those of 64-bit polynomial fingerprints along
with that of the anchor's; all else compares bytes.

Defined cases: a null or empty text has no bytes; texts shorter than `length` lose nothing; a long text
is hashed in stretches of STEP bytes; occurrences may overlap, within a text too; a repeated row is
another occurrence; rows are told apart by two 64-bit hashes of doc_id and text; an empty table gives
no rows; other columns, whatever their names, come back as they are or are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import bytes_of, drop_stored, n_bytes, parts_for, small_batches, stored, trim, trimmed

LENGTH, GRAM = 200, 64
#: Segments of a range of anchors that one task takes; a range has about a third of that.
RANGE_ELEMENTS = 2_000_000
#: Bytes of text for each range of anchors; of segments in a shard; of text hashed at a time.
RANGE_BYTES, SHARD_BYTES, STEP = 32 << 20, 2 << 20, 256 << 10
#: Parts by content of a range that is dealt over tasks, at most.
PIECES = 256

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 1 << 64, 256, np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_UNBASE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_POS_BITS = 28


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class _Powers:
    """Powers of the fingerprint's base and of its inverse, as far as needed so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n, b)])) for b in (_BASE, _UNBASE))
        return self.up, self.down


_POWERS = _Powers()


def _sums(raw: np.ndarray) -> np.ndarray:
    up, _ = _POWERS.to(len(raw) + 1)
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)], dtype=np.uint64)])


def _prints(sums: np.ndarray, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Fingerprints of the strings between `first` and `stop`."""
    return mix((sums[stop] - sums[first]) * _POWERS.to(len(sums))[1][first])


def segments(texts: list[bytes], length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window, windows - 1, anchor's place in it, anchor, fingerprint) of every segment."""
    sizes = np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(texts), np.uint8)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if len(raw) < length:
        return none
    sums = _sums(raw)
    places = np.arange(len(raw) - gram + 1)
    grams = mix((sums[gram:] - sums[:-gram]) * _POWERS.to(len(sums))[1][: len(places)])
    low = (grams >> np.uint64(_POS_BITS) << np.uint64(_POS_BITS)) | places.astype(np.uint64)
    span, reach = length - gram + 1, 1
    while reach * 2 <= span:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if span > reach:
        low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(low)]
    valid = np.arange(len(low)) + length <= ends[owner]
    window = np.flatnonzero(valid)
    if not len(window):
        return none
    anchor = (low[window] & np.uint64((1 << _POS_BITS) - 1)).astype(np.int64)
    own = owner[window]
    new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(own, prepend=-1) != 0))
    last = window[np.append(new[1:], len(window)) - 1]
    first, anchor, own = window[new], anchor[new], own[new]
    spread = last - first
    key = _prints(sums, first, last + length) + mix((spread.astype(np.uint64) << np.uint64(20)) + (anchor - first).astype(np.uint64))
    return own, first - (ends - sizes)[own], spread, anchor - first, mix(grams[anchor]), mix(key)


_ELEMENT = np.dtype([("anchor", "<u8"), ("key", "<u8"), ("row", "<i8"), ("twin", "<i8"), ("first", "<u4"), ("spread", "<u2")])
#: A row is known by two hashes of 64 bits.
ROW = ["row_id", "row_twin"]


def _slices(texts: list[bytes], length: int) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Stretches of the texts of up to STEP bytes together, (text, its first byte, bytes): each window
    lies in one of them, so that a long text costs no more memory than many short ones."""
    own: list[int] = []
    begin: list[int] = []
    parts: list[bytes] = []
    room = STEP
    for k, text in enumerate(texts):
        for a in range(0, max(1, len(text) - length + 1), STEP):
            part = text[a : a + STEP + length - 1]
            if parts and len(part) > room:
                yield own, begin, parts
                own, begin, parts, room = [], [], [], STEP
            own.append(k)
            begin.append(a)
            parts.append(part)
            room -= len(part)
    if parts:
        yield own, begin, parts


def _anchored(rows: DataFrame, length: int, gram: int, ranges: int) -> DataFrame:
    """(at, elements): the segments of the rows (ROW, text), by ranges of their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, size=8 << 20):
            found = []
            ids = [batch.column(c).to_numpy() for c in ROW]
            for whose, begin, parts in _slices(bytes_of(batch), length):
                own, first, spread, _, anchor, key = segments(parts, length, gram)
                out = np.zeros(len(own), _ELEMENT)
                out["anchor"], out["key"], out["first"], out["spread"] = anchor, key, first + np.array(begin)[own], spread
                out["row"], out["twin"] = (x[np.array(whose)[own]] for x in ids)
                found.append(out)
            flat = np.concatenate(found)
            at = (((flat["anchor"] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            flat, at = flat[order], at[order]
            cuts = np.flatnonzero(np.diff(at, prepend=-1, append=ranges))
            blobs = [flat[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(at[cuts[:-1]], pa.int32()), pa.array(blobs, pa.binary())], ["at", "elements"])

    return rows.mapInArrow(trimmed(run), "at int, elements binary")


#: Spans of a row: those that repeat (anchor null), and those to be compared in an anchor's shard.
SPANS = "row_id long, row_twin long, first int, stop int, anchor long"


def _blobs(tables, column: str = "elements", kind=_ELEMENT) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for t in tables for x in t.column(column).to_pylist() if x)])


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


def _grouped(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Elements by anchor and key, where each key begins, and where each anchor does."""
    flat = flat[np.lexsort((flat["first"], flat["twin"], flat["row"], flat["key"], flat["anchor"]))]
    return flat, _starts(flat["anchor"], flat["key"]), _starts(flat["anchor"])


def covering(row: np.ndarray, twin: np.ndarray, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The maximal stretches of each row that spans cover together."""
    order = np.lexsort((first, twin, row))
    row, twin, first, stop = row[order], twin[order], first[order].astype(np.int64), stop[order].astype(np.int64)
    new = np.zeros(len(row), bool)
    new[_starts(row, twin)] = True
    place = np.cumsum(new) << 32
    reach = np.maximum.accumulate(stop + place) - place if len(row) else stop
    begin = new.copy()
    begin[1:] |= first[1:] > reach[:-1]
    at = np.flatnonzero(begin)
    return row[at], twin[at], first[at], reach[np.append(at[1:], len(row)) - 1] if len(at) else stop


def _spans(flat: np.ndarray, length: int, compared: bool) -> pa.RecordBatch:
    row, twin, first = flat["row"].copy(), flat["twin"].copy(), flat["first"].astype(np.int64)
    stop = first + flat["spread"] + length
    if not compared:
        row, twin, first, stop = covering(row, twin, first, stop)
    anchor = pa.array(flat["anchor"].view(np.int64)) if compared else pa.nulls(len(row), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(twin), pa.array(first, pa.int32()), pa.array(stop, pa.int32()), anchor], [x.split()[0] for x in SPANS.split(", ")])


def _each(starts: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.append(starts, n))


def _kinds(keys: np.ndarray, anchors: np.ndarray) -> np.ndarray:
    """How many keys each anchor has."""
    return np.diff(np.append(np.searchsorted(keys, anchors), len(keys)))


def _met(elements: DataFrame, length: int, limit: int) -> DataFrame:
    """SPANS of the segments whose anchor occurs again.

    A range of up to `limit` elements is one task's. A larger one holds an anchor that very many rows
    share: its elements are dealt by their rows. Each share asks, with one element of each content and
    its count up to two, pieces of the range that are dealt by content; these answer each share which
    of its own contents repeat. No task sees all elements or all contents of such a range.
    """

    def direct(_: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = _blobs(tables)
        flat = flat[np.argsort(flat["anchor"], kind="stable")]
        sizes = _each(_starts(flat["anchor"]), len(flat))
        flat, keys, anchors = _grouped(flat[np.repeat(sizes > 1, sizes)])
        same, kinds = _each(keys, len(flat)), _kinds(keys, anchors)
        yield _spans(flat[np.repeat(same > 1, same)], length, False)
        yield _spans(flat[keys[np.repeat(kinds > 1, kinds)]], length, True)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, shares, blob in zip(*(batch.column(c).to_pylist() for c in ("at", "shares", "elements")), strict=True):
                flat = np.frombuffer(blob, _ELEMENT)
                share = mix(flat["row"].view(np.uint64)) % np.uint64(shares)
                own = [(k, flat[share == k].tobytes()) for k in np.unique(share).tolist()]
                cols = [pa.array([x] * len(own), pa.int32()) for x in (at, shares)] + [pa.array([k for k, _ in own], pa.int32()), pa.array([x for _, x in own], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["at", "shares", "share", "elements"])

    def asked(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, share, shares = (k.as_py() for k in key)
        flat, keys, _ = _grouped(_blobs(tables))
        counts, flat = np.minimum(_each(keys, len(flat)), 2).astype(np.uint8), flat[keys]
        piece = mix(flat["anchor"] ^ flat["key"]) % np.uint64(min(shares, PIECES))
        for k in np.unique(piece).tolist():
            own = piece == k
            cols = [pa.array([x], pa.int32()) for x in (at, k, share)] + [pa.array([x[own].tobytes()], pa.binary()) for x in (flat, counts)]
            yield pa.RecordBatch.from_arrays(cols, ["at", "piece", "share", "elements", "counts"])

    answers = "at int, share int, elements binary, anchors binary, kinds binary"

    def answered(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(tables)
        flat, count = _blobs(tables), _blobs(tables, "counts", np.uint8).astype(np.int64)
        share = np.repeat([x for t in tables for x in t.column("share").to_pylist()], [len(x) // _ELEMENT.itemsize for t in tables for x in t.column("elements").to_pylist()])
        order = np.lexsort((flat["first"], flat["twin"], flat["row"], flat["key"], flat["anchor"]))
        flat, count, share = flat[order], count[order], share[order]
        keys, anchors = _starts(flat["anchor"], flat["key"]), _starts(flat["anchor"])
        again = np.repeat(np.add.reduceat(count, keys) > 1, _each(keys, len(flat))) if len(keys) else np.zeros(0, bool)

        def row(share: int | None, own: np.ndarray, *more: np.ndarray) -> pa.RecordBatch:
            blobs = [pa.array([x.tobytes()], pa.binary()) for x in (own, *more)] + [pa.nulls(1, pa.binary())] * (2 - len(more))
            return pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([share], pa.int32()), *blobs], [x.split()[0] for x in answers.split(", ")])

        for k in np.unique(share[again]).tolist():
            yield row(k, flat[again & (share == k)])
        yield row(None, flat[keys], flat["anchor"][anchors], np.minimum(_kinds(keys, anchors), 2).astype(np.uint8))

    def several(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = list(tables)
        anchor, kinds = _blobs(tables, "anchors", np.uint64), _blobs(tables, "kinds", np.uint8)
        anchor, at = np.unique(anchor, return_inverse=True)
        found = anchor[np.bincount(at, kinds, len(anchor)) > 1]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([found.tobytes()], pa.binary())], ["at", "met"])

    def returned(key: tuple, own: pa.Table, told: pa.Table) -> pa.Table:
        flat, whole = _blobs(own.to_batches()), _blobs(told.to_batches())
        both = np.concatenate([whole, flat])
        order = np.lexsort((np.arange(len(both)), both["key"], both["anchor"]))
        both = both[order]
        starts = _starts(both["anchor"], both["key"])
        hit = np.repeat(order[starts] < len(whole), _each(starts, len(both)))
        return pa.Table.from_batches([_spans(both[hit & (order >= len(whole))], length, False)])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, met in zip(batch.column("elements").to_pylist(), batch.column("met").to_pylist(), strict=True):
                flat = np.frombuffer(blob, _ELEMENT)
                yield _spans(flat[np.isin(flat["anchor"], np.frombuffer(met, np.uint64))], length, True)

    held = elements.groupBy("at").agg(F.sum(F.octet_length("elements")).alias("n")).withColumn("shares", F.ceil(F.col("n") / (limit * _ELEMENT.itemsize)).cast("int"))
    held = stored(held, "ranges")
    light = elements.join(held.where("shares <= 1").select("at"), "at").groupBy("at").applyInArrow(direct, SPANS)
    heavy = held.where("shares > 1").select("at", "shares")
    if heavy.isEmpty():
        return light
    dealt = stored(elements.join(heavy, "at").select("at", "shares", "elements").mapInArrow(deal, "at int, shares int, share int, elements binary"), "shares")
    asks = dealt.groupBy("at", "share", "shares").applyInArrow(asked, "at int, piece int, share int, elements binary, counts binary")
    told = stored(asks.groupBy("at", "piece").applyInArrow(answered, answers), "told")
    contents = told.where("share is null")
    met = contents.select("at", "anchors", "kinds").groupBy("at").applyInArrow(several, "at int, met binary")
    replies = told.where("share is not null").select("at", "share", "elements")
    back = dealt.groupBy("at", "share").cogroup(replies.groupBy("at", "share")).applyInArrow(returned, SPANS)
    return light.unionByName(back).unionByName(contents.join(met, "at").select("elements", "met").mapInArrow(listed, SPANS))


def suffix_array(raw: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """Order of all suffixes of `raw`, each up to its `end`, by their first `depth` bytes at least.

    Larsson-Sadakane refinement: ranks are places of groups in the order; a group of one is final.
    """
    n = len(raw)
    place, end = np.arange(n, dtype=np.int32), end.astype(np.int32)
    key = np.zeros(n, np.uint64)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).astype(np.uint16) + np.uint16(1)
    for k in range(7):  # bytes from 1 to 256 in base 257 leave 0 for the end
        key *= np.uint64(257)
        key += np.where(place + k < end, padded[k : n + k], np.uint16(0))
    del place, padded
    order = np.argsort(key, kind="stable")
    group = _starts(key[order])
    del key
    rank = np.zeros(n + 1, np.int32)  # what lies behind an end ranks 0, all else from 1 on
    sizes = np.diff(np.append(group, n))
    rank[order] = np.repeat(group, sizes) + 1
    live = np.repeat(sizes > 1, sizes)
    at = np.flatnonzero(live)  # places in the order that belong to groups of several
    h = 7
    while h < depth and len(at):
        own = order[at]
        after = np.where(own + h < end[own], own + h, n)
        both = (rank[own].astype(np.int64) << 32) | rank[after]
        by = np.argsort(both, kind="stable")
        own, both = own[by], both[by]
        order[at] = own
        new = np.diff(both, prepend=-1) != 0
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(own)))
        rank[own] = np.repeat(at[starts], sizes) + 1
        at = at[np.repeat(sizes > 1, sizes)]
        h *= 2
    return order


def common_prefixes(raw: np.ndarray, first: np.ndarray, stop: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """For every suffix, the bytes up to `depth` that it shares with the one before it in the order.

    Kasai's method: a suffix shares at least one byte less than the one that begins a byte earlier.
    All segments [first, stop) advance in step.
    """
    n = len(raw)
    before = np.full(n, -1, np.int32)
    before[order[1:]] = order[:-1]
    end = np.repeat(stop, stop - first).astype(np.int32)
    shared = np.zeros(n, np.int32)
    at, h, until = first.copy(), np.zeros(len(first), np.int64), stop
    while len(at):
        prev = before[at]
        x, y = at + h, prev + h
        ok = (prev >= 0) & (x < until) & (h < depth)
        ok[ok] = y[ok] < end[prev[ok]]
        ok[ok] = raw[x[ok]] == raw[y[ok]]
        done = ~ok
        shared[at[done]] = h[done]
        h = np.where(done, np.maximum(h - 1, 0), h + 1)
        at = at + done
        left = at < until
        if not left.all():
            at, h, until = at[left], h[left], until[left]
    return shared


def repeated_windows(segs: list[bytes], length: int) -> np.ndarray:
    """For every byte of the joined segments: whether a window that occurs again begins there."""
    sizes = np.array([len(s) for s in segs], np.int64)
    stop = np.cumsum(sizes)
    raw = np.frombuffer(b"".join(segs), np.uint8)
    # A complete order, equal suffixes in that of their places, is what Kasai's bound rests on.
    order = suffix_array(raw, np.repeat(stop, sizes), int(sizes.max(initial=0)))
    shared = common_prefixes(raw, stop - sizes, stop, order, length)[order] >= length
    out = np.zeros(len(raw), bool)
    out[order] = shared | np.append(shared[1:], False)
    return out


def _cut(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(anchor, ROW, first, segment) of the wanted spans."""
    wanted = wanted.groupBy(*ROW).agg(F.collect_list(F.struct("first", "stop", "anchor")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out: list[list] = [[], [], [], [], []]
            for *row, text, spans in zip(*(batch.column(c).to_pylist() for c in ROW), bytes_of(batch), batch.column("spans").to_pylist(), strict=True):
                for s in spans:
                    for col, value in zip(out, (s["anchor"], *row, s["first"], text[s["first"] : s["stop"]]), strict=True):
                        col.append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["anchor", *ROW, "first", "segment"])

    # A repeated row brings its segments once for each copy; one is enough, its copies repeat as wholes.
    return rows.join(wanted, ROW).mapInArrow(trimmed(run), "anchor long, row_id long, row_twin long, first int, segment binary").dropDuplicates(["anchor", *ROW, "first"])


def _compared(segs: DataFrame, length: int, shard_bytes: int) -> DataFrame:
    """(ROW, first, stop) of the windows that segments of one anchor share."""
    buckets = parts_for(segs.agg(F.sum(F.octet_length("segment"))).first()[0] or 0, shard_bytes // 2)
    segs = segs.withColumn("bucket", F.pmod(F.xxhash64("anchor"), F.lit(buckets)))
    held = segs.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("segment")) / shard_bytes).cast("int").alias("shards"))
    dealt = segs.join(held, "bucket").withColumn("shard", F.pmod(F.xxhash64("row_id", "first"), F.col("shards")).cast("int"))
    schema = "row_id long, row_twin long, first int, stop int, bucket long, shard int, print long"

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in (*ROW, "first")])
        segs = rows.column("segment").to_pylist()
        row, twin, first = (rows.column(c).to_numpy() for c in (*ROW, "first"))
        sizes = np.array([len(s) for s in segs], np.int64)
        begin = np.cumsum(sizes) - sizes
        again = repeated_windows(segs, length)
        edges = np.diff(again.astype(np.int8), prepend=0, append=0)
        starts, stops = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        own = np.searchsorted(begin, starts, side="right") - 1
        cols = [row[own], twin[own], first[own] + starts - begin[own], first[own] + stops - 1 + length - begin[own]]
        extra = [np.zeros(0, np.int64)] * 4
        prints = np.zeros(0, np.int64)
        if rows.column("shards")[0].as_py() > 1:  # windows of this shard that may occur in another one
            raw = np.frombuffer(b"".join(segs), np.uint8)
            sums = _sums(raw)
            seg = np.repeat(np.arange(len(segs)), sizes)
            window = np.flatnonzero(np.arange(len(raw)) + length <= (begin + sizes)[seg])
            values = _prints(sums, window, window + length).view(np.int64)
            lone = ~again[window]
            partner = np.flatnonzero(~lone)[np.unique(values[~lone], return_index=True)[1]]
            keep = np.sort(np.concatenate([np.flatnonzero(lone), partner]))
            window, prints = window[keep], values[keep]
            own = seg[window]
            extra = [row[own], twin[own], first[own] + window - begin[own], first[own] + window - begin[own] + length]
        n, m = len(starts), len(prints)
        data = [np.concatenate([a, b]) for a, b in zip(cols, extra, strict=True)]
        bucket, shard = (k.as_py() for k in key)
        trim()
        return pa.table(
            {
                "row_id": pa.array(data[0], pa.int64()),
                "row_twin": pa.array(data[1], pa.int64()),
                "first": pa.array(data[2], pa.int32()),
                "stop": pa.array(data[3], pa.int32()),
                "bucket": pa.array(np.full(n + m, bucket), pa.int64()),
                "shard": pa.array(np.full(n + m, shard), pa.int32()),
                "print": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(prints, pa.int64())]),
            }
        )

    def merge(_: tuple, rows: pa.Table) -> pa.Table:
        shard, prints = rows.column("shard").to_numpy(), rows.column("print").to_numpy()
        met = np.zeros(len(prints), bool)
        lists = {k: np.unique(prints[shard == k]) for k in np.unique(shard)}
        merged, counts = np.unique(np.concatenate(list(lists.values())), return_counts=True)
        for k, own in lists.items():
            mine = np.flatnonzero(shard == k)
            met[mine] = counts[np.searchsorted(merged, prints[mine])] > 1
        data = covering(*(rows.column(c).to_numpy()[met] for c in (*ROW, "first", "stop")))
        return pa.table({c: pa.array(x, k) for c, x, k in zip((*ROW, "first", "stop"), data, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)})

    found = stored(dealt.select("bucket", "shard", "shards", *ROW, "first", "segment").groupBy("bucket", "shard").applyInArrow(run, schema), "windows")
    open_ = found.where("print is not null").withColumn("part", F.expr("shiftrightunsigned(print, 52)"))
    crossed = open_.select("bucket", "part", "shard", *ROW, "first", "stop", "print").groupBy("bucket", "part").applyInArrow(
        lambda key, rows: merge(key, rows), "row_id long, row_twin long, first int, stop int"
    )
    return found.where("print is null").select(*ROW, "first", "stop").unionByName(crossed)


def with_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, range_elements: int = RANGE_ELEMENTS) -> DataFrame:
    """Every row of `docs` as `row`, with `spans`: the stretches (first, stop) of its text's UTF-8 bytes that repeat.

    Spans may overlap and are in no order; null where there are none.
    """
    seeds = (1, 2)
    known = [F.xxhash64(F.lit(k), "doc_id", F.col("text").cast("string"), F.lit(-k)).alias(c) for c, k in zip(ROW, seeds, strict=True)]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *known)
    texts = rows.select(*ROW, F.col("row.text").cast("string").alias("text")).where(f"octet_length(text) >= {length}")
    ranges = parts_for(n_bytes(texts), RANGE_BYTES)
    elements = stored(_anchored(texts, length, gram, ranges), "anchors")
    met = stored(_met(elements, length, range_elements), "spans")
    drop_stored(elements)
    wanted = met.where("anchor is not null")
    whole = met.where("anchor is null").select(*ROW, "first", "stop")
    shared = _compared(stored(_cut(texts, wanted), "segments"), length, shard_bytes)
    spans = whole.unionByName(shared).groupBy(*ROW).agg(F.collect_list(F.struct("first", "stop")).alias("spans"))
    return rows.join(spans, ROW, "left").select("row", "spans")


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that spans cover, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((s["first"], s["stop"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    return b"".join(kept) + text[at:]


def digests(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, range_elements: int = RANGE_ELEMENTS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the SHA-256 of what remains, for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            out: list[tuple] = []
            for text, spans in zip(bytes_of(batch), batch.column("spans").to_pylist(), strict=True):
                runs = merged(spans)
                out.append((len(text), sum(b - a for a, b in runs), len(runs), hashlib.sha256(without(text, runs)).hexdigest()))
            cols = zip(*out, strict=True)
            kinds = [pa.int64()] * 3 + [pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = with_spans(docs, length, gram, shard_bytes, range_elements)
    return found.select("row.doc_id", "row.text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """All columns of `docs`, the text without its repeated stretches. Code points that a stretch cuts go with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column("text").to_pylist()
            for k, spans in enumerate(batch.column("spans").to_pylist()):
                if spans:
                    texts[k] = without(texts[k].encode(), merged(spans)).decode("utf-8", "ignore")
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    found = with_spans(docs, length).select("row", F.col("row.text").cast("string").alias("text"), "spans")
    whole = StructType([StructField("row", docs.schema), StructField("text", StringType())])
    out = found.mapInArrow(run, whole)
    return out.select(*[F.col("text").cast(docs.schema["text"].dataType) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])
