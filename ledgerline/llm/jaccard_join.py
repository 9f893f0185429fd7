"""N-gram Jaccard join: links between texts whose word-shingle sets are similar, and their classes.

Every text becomes the set of the 64-bit hashes of its distinct shingles. Three steps find all links:

1. Candidate groups. The sizes of two similar sets differ little, so sets are banded by size. For
   each band the hash space is cut into one part more than the largest symmetric difference that a
   similar pair can have (and some to spare); such a pair agrees on a whole part, and on as many more as
   are spare. So each text passes over its most frequent parts, one fewer than it must share with any
   similar text: in one order of all parts, a similar pair keeps the rarest that it shares. This leaves out
   passages that many texts quote, which would chain them into one group. Texts that share the hash of a
   part that both keep come into one group; no pairs are emitted.
2. Tiles. Texts with equal sets are represented by the smallest id. The representatives of a group
   form one tile, or, in a large group, blocks by size band whose pairs are the tiles, so that a task
   holds a bounded number of sets. Within a tile, bitmaps of hashed shingles bound the overlap of two
   sets from above by their bit counts; pairs that pass are verified by exact intersection of sorted
   arrays, unless links found before already connect them.
3. Classes are the connected components of the verified links.

Defined cases: a null or empty text has no shingles and links with nothing; a text of fewer words
than a shingle is one shingle; equal texts link; rows of one doc_id are one node with the union of
their links, and keep one output row each; a null doc_id links with nothing and is its own null
component; an empty table gives no rows; columns besides doc_id and text are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, drop_stored, n_bytes, parts_for, small_batches, stored, trim, trimmed
from .components import connected, forest

#: Sets and shingles that a tile's block holds on average, at most.
BLOCK_SETS, BLOCK_SHINGLES = 8192, 1 << 22
#: Part hashes in each range of them that one task searches, on average.
RANGE_HASHES = 5_000_000
#: Hashes of a range beyond which it is dealt over several tasks.
SPLIT_HASHES = 10_000_000
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX[1]
    x = x ^ (x >> np.uint64(27))
    x = x * _MIX[2]
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    """64-bit hashes of words, kept for those seen."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return value


_WORDS = _Words()


def shingles(text: bytes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text, its letters A-Z lower-cased."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > 200_000:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    size = min(n, len(h))
    out = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        out = mix(out * _MIX[0] + h[k : len(h) - size + 1 + k])
    return np.unique(out)


class Bands:
    """Size bands and numbers of parts for links of `num` hundredths of similarity."""

    def __init__(self, num: int):
        self.num = num
        self.low = [1]

    def _grow(self, size: int) -> None:
        while self.low[-1] <= size:
            self.low.append(max(self.low[-1] + 1, -(-self.low[-1] * 100 // self.num)))

    def of(self, size: int) -> int:
        """The band of a set's size; similar sets are in one band or in neighbouring ones."""
        self._grow(size)
        return int(np.searchsorted(self.low, size, side="right")) - 1

    def parts(self, band: int) -> tuple[int, int]:
        """Largest symmetric difference of a similar pair whose smaller set is in the band; parts."""
        while len(self.low) <= band + 1:
            self._grow(self.low[-1])
        a = self.low[band + 1] - 1
        b = a * 100 // self.num
        most = (100 - self.num) * (a + b) // (100 + self.num)
        return most, most + 1 + -(-most // 8) + 8


def part_hashes(own: np.ndarray, bands: Bands) -> tuple[np.ndarray, list[int]]:
    """The hashes by which a set meets every set similar to it, their lowest bit that of their level; and for
    levels of either bit, how many of these hashes may be passed over, as long as all sets do so in one order.

    Of the parts that hold something, at most `most` differ from those of a similar set.
    """
    out, spare = [], [0, 0]
    band = bands.of(len(own))
    for level in (band, band - 1) if band else (band,):
        most, n = bands.parts(level)
        spread = mix(own + np.uint64((level + 1) * int(_MIX[0]) % (1 << 64)))
        part = ((spread >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
        order = np.argsort(part, kind="stable")
        sums = mix(spread)[order]
        part = part[order]
        first = np.flatnonzero(np.diff(part, prepend=np.uint64(n)))
        level_key = np.uint64(level + 1) << np.uint64(40)
        found = [mix(np.add.reduceat(sums, first) + mix(level_key + part[first]))]
        if len(first) <= most:  # it may agree with a similar set on empty parts alone
            empty = np.setdiff1d(np.arange(n, dtype=np.uint64), part[first])
            found.append(mix(mix(level_key + empty) ^ _MIX[0]))
        spare[level & 1] = max(0, len(first) - most - 1)
        out += [(x & ~np.uint64(1)) | np.uint64(level & 1) for x in found]
    return np.concatenate(out), spare


def _five(values: np.ndarray) -> bytes:
    """The lower 40 bits of each value, in five bytes."""
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _dealt(to: np.ndarray, own: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each value of `to`: it, where it stands by owner, its owners, and how often each of these occurs."""
    order = np.lexsort((own, to))
    cuts = np.append(np.flatnonzero(np.diff(to[order], prepend=-1)), len(to))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(to[order[a]]), order[a:b], *np.unique(own[order[a:b]], return_counts=True)


def _sets(docs: DataFrame, n: int, num: int, ranges: int) -> DataFrame:
    """Rows of two kinds: (doc_id, n_shingles, set_key) of each text, and blobs of part hashes for
    each range (at, parts, ids, counts, spare): for every text in the blob, how many of its hashes follow,
    and how many of all that it has at levels of either bit may be passed over."""
    schema = "doc_id long, n_shingles long, key_a long, key_b long, at int, parts binary, ids binary, counts binary, spare binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands = Bands(num)
        names = [x.split()[0] for x in schema.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.int32()] + [pa.binary()] * 4
        for batch in small_batches(batches, size=4 << 20):
            ids = batch.column("doc_id").to_pylist()
            sets = [shingles(t, n) for t in bytes_of(batch)]
            sizes = [len(s) for s in sets]
            sums = [(int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ _MIX[2]).sum(dtype=np.uint64))) for s in sets]
            keys = np.array(sums, np.uint64).reshape(-1, 2).view(np.int64)
            empty = [None] * len(ids)
            cols = [ids, sizes, keys[:, 0], keys[:, 1], *[empty] * 5]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
            live = [k for k in range(len(ids)) if sizes[k] and ids[k] is not None]
            if not live:
                continue
            hashes, spare = zip(*(part_hashes(sets[k], bands) for k in live), strict=True)
            del sets
            spare = np.minimum(spare, 255).astype(np.uint8)  # to pass over fewer is always right
            own = np.repeat(np.arange(len(live)), [len(h) for h in hashes])
            flat = np.concatenate(hashes)
            owners = np.array([ids[k] for k in live], np.int64)
            at = (((flat >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(np.int64)
            # 40 bits tell texts of a range apart, one of them the level's; chance agreement only enlarges a group
            flat = ((flat * _MIX[0] >> np.uint64(24)) & ~np.uint64(1)) | (flat & np.uint64(1))
            for to, here, present, counts in _dealt(at, own):
                values = [None, None, None, None, to, _five(flat[here]), owners[present].tobytes(), counts.astype("<u4").tobytes(), spare[present].tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names)
        _WORDS.clear()

    return docs.select("doc_id", "text").mapInArrow(trimmed(run), schema)


_OWNER = 24  # bits of a place among a task's texts; the rest of 64 holds a part's hash


def _led(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Links of all texts that agree on a part to the smallest of them, as a forest; parts and that text.

    `keys` are parts with the places of their texts in `ids`, which are sorted: the first of a part's keys
    is its smallest text's. They are sorted in place.
    """
    keys.sort()
    owner = (keys & np.uint64((1 << _OWNER) - 1)).astype(np.int32)
    keys >>= np.uint64(_OWNER)
    first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
    lead = owner[first]
    to = np.repeat(lead, np.diff(np.append(first, len(keys))))
    differ = owner != to
    pairs = np.unique((owner[differ].astype(np.int64) << 32) | to[differ])
    return *forest(ids[pairs >> 32], ids[pairs & 0xFFFFFFFF]), keys[first], ids[lead]


def _keyed(parts: np.ndarray, places: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if len(ids) >> _OWNER:
        raise ValueError(f"{len(ids)} texts in one range; lower SPLIT_HASHES")
    return (parts << np.uint64(_OWNER)) | places.astype(np.uint64)


def _gathered(tables: Iterator[pa.RecordBatch], *columns: str) -> tuple[np.ndarray, ...]:
    """Parts, the places of their texts in ids, and ids, of rows of blobs; and for further columns: bytes of
    each text as the least of its rows (spare), or values of each part."""
    held = [x for rows in tables for x in zip(*([v.as_buffer() if hasattr(v, "as_buffer") else v.as_py() for v in rows.column(c)] for c in ("parts", "ids", "counts", *columns)), strict=True)]
    counts = [np.frombuffer(x[2], "<u4") for x in held]
    ids, places = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(x[1], np.int64) for x in held)]), return_inverse=True)
    parts = np.empty(sum(x[0].size for x in held) // 5, np.uint64)
    own = np.empty(len(parts), np.int32)
    more: list[np.ndarray] = []
    for c in columns:
        more.append(np.full((len(ids), 2), 255, np.uint8) if c == "spare" else np.empty(len(parts), np.int64))
    at = k = 0
    for x, n in zip(held, counts, strict=True):
        raw = unpacked(x[0])
        own[at : at + len(raw)] = np.repeat(places[k : k + len(n)], n)
        parts[at : at + len(raw)] = raw
        for c, values, v in zip(columns, more, x[3:], strict=True):
            if c == "spare":
                np.minimum.at(values, places[k : k + len(n)], np.frombuffer(v, np.uint8).reshape(-1, 2))
            else:
                values[at : at + len(raw)] = np.frombuffer(v, "<u2") if c == "often" else v
        at, k = at + len(raw), k + len(n)
    return parts, own, ids, *more


def _rarest(blobs: DataFrame, limit: int, buckets: int) -> DataFrame:
    """Blobs (at, parts, ids, counts) without the parts that only one text has, and without those that each
    text passes over: of its parts at a level the most frequent ones, as many as are spare.

    Frequent stands for a number of texts counted where a range is one task's. Parts of larger ranges count as
    the rarest, and texts of a bucket above `limit` pass over none; both go on whole.
    """

    def agreeing(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, own, ids, spare = _gathered(tables, "spare")
        keys = _keyed(parts, own, ids)
        del parts, own
        keys.sort()
        own = (keys & np.uint64((1 << _OWNER) - 1)).astype(np.int32)
        keys >>= np.uint64(_OWNER)
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0)
        often = np.diff(np.append(first, len(keys)))
        often = np.repeat(np.minimum(often, 65535).astype("<u2"), often)
        keys, own, often = keys[often > 1], own[often > 1], often[often > 1]
        bucket = (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        cols: list[list] = [[], [], [], [], [], [], []]
        for to, here, present, counts in _dealt(bucket[own], own):
            row = (to, key[0].as_py(), _five(keys[here]), ids[present].tobytes(), counts.astype("<u4").tobytes(), spare[present].tobytes(), often[here].tobytes())
            for c, v in zip(cols, row, strict=True):
                c.append(v)
        kinds = [pa.int32()] * 2 + [pa.binary()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["bucket", "at", "parts", "ids", "counts", "spare", "often"])
        del keys, own, often
        trim()

    def kept(_: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, own, ids, spare, often, at = _gathered(tables, "spare", "often", "at")
        unit = own.astype(np.int64) * 2 + (parts & np.uint64(1)).astype(np.int64)
        order = np.lexsort((parts, at, -often, unit))
        unit = unit[order]
        first = np.flatnonzero(np.diff(unit, prepend=-1))
        rank = np.arange(len(unit)) - np.repeat(first, np.diff(np.append(first, len(unit))))
        order = order[rank >= spare.ravel()[unit]]
        parts, own, at = parts[order], own[order], at[order]
        rows = [(to, _five(parts[here]), ids[present].tobytes(), counts.astype("<u4").tobytes()) for to, here, present, counts in _dealt(at, own)]
        kinds = [pa.int32()] + [pa.binary()] * 3
        cols = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["at", "parts", "ids", "counts"])
        trim()

    held = lambda rows, by: stored(rows.groupBy(by).agg((F.sum(F.octet_length("parts")) > 5 * limit).alias("large")), by + "s")
    schema = "at int, parts binary, ids binary, counts binary"
    names = [x.split()[0] for x in schema.split(", ")]
    ranges = held(blobs, "at")
    found = blobs.join(ranges.where("not large").select("at"), "at").groupBy("at").applyInArrow(agreeing, f"bucket int, {schema}, spare binary, often binary")
    found = stored(found, "agreeing")
    texts = held(found, "bucket")
    rare = found.join(texts.where("not large").select("bucket"), "bucket").groupBy("bucket").applyInArrow(kept, schema)
    rare = rare.unionByName(found.join(texts.where("large"), "bucket").select(names))
    rare = stored(rare.unionByName(blobs.join(ranges.where("large"), "at").select(names)), "rarest")
    drop_stored(found)
    return rare


def _group_links(blobs: DataFrame, limit: int) -> DataFrame:
    """Links (a, b) that join all texts agreeing on a part: each to the smallest of them.

    A range of up to `limit` hashes is one task's. A larger one, where very many texts agree, is
    dealt over several, which hand on one text for each part.
    """

    def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    def direct(_: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, own, ids = _gathered(tables)
        yield links(*_led(_keyed(parts, own, ids), ids)[:2])
        trim()

    def shared(key: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, own, ids = _gathered(tables)
        found = [pa.array([x.tobytes()], pa.binary()) for x in _led(_keyed(parts, own, ids), ids)]
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), *found], ["at", "a", "b", "part", "lead"])

    def merged(_: tuple, tables: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [t.to_pydict() for t in tables]
        part, lead = (np.concatenate([np.frombuffer(x, kind) for t in rows for x in t[c]]) for c, kind in (("part", np.uint64), ("lead", np.int64)))
        ids, places = np.unique(lead, return_inverse=True)
        yield links(*_led(_keyed(part, places, ids), ids)[:2])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                yield links(np.frombuffer(a, np.int64), np.frombuffer(b, np.int64))

    blobs = blobs.select("at", "parts", "ids", "counts")
    held = stored(blobs.groupBy("at").agg(F.ceil(F.sum(F.octet_length("parts")) / (5 * limit)).cast("int").alias("shares")), "ranges")
    schema = "a long, b long"
    light = blobs.join(held.where("shares <= 1").select("at"), "at").groupBy("at").applyInArrow(direct, schema)
    heavy = held.where("shares > 1")
    if heavy.isEmpty():
        return light
    dealt = blobs.join(heavy, "at").withColumn("share", F.pmod(F.xxhash64("ids", "parts"), F.col("shares")).cast("int")).drop("shares")
    shares = stored(dealt.groupBy("at", "share").applyInArrow(shared, "at int, a binary, b binary, part binary, lead binary"), "shares")
    return light.unionByName(shares.mapInArrow(listed, schema)).unionByName(shares.select("at", "part", "lead").groupBy("at").applyInArrow(merged, schema))


def _bitmaps(sets: list[np.ndarray], bits: int) -> np.ndarray:
    """For each set, the parity of its elements at each of `bits` places."""
    out = np.zeros((len(sets), bits), np.uint8)
    for row, s in zip(out, sets, strict=True):
        row[:] = np.bincount((mix(s) >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1
    return np.packbits(out, axis=1).view(np.uint64)


def tile_links(ids: np.ndarray, sets: list[np.ndarray], block: np.ndarray, num: int) -> tuple[np.ndarray, np.ndarray]:
    """(id, smallest id of its class) for the links of a tile; with two blocks, only those across."""
    order = np.argsort([len(s) for s in sets], kind="stable")
    ids, block, sets = ids[order], block[order], [sets[k] for k in order]
    size = np.array([len(s) for s in sets])
    across = len(np.unique(block)) > 1
    bits = 1 << max(6, int(2 * size.max(initial=1) - 1).bit_length())
    bits = min(bits, 1 << 16)  # wider sets are bounded less sharply
    maps = np.concatenate([_bitmaps(sets[a : a + 64], bits) for a in range(0, len(sets), 64)])
    root = np.arange(len(sets))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i in range(len(sets)):
        # 100 * overlap >= num * union and overlap <= smaller bound the larger set's size
        stop = int(np.searchsorted(size, size[i] * 100 // num, side="right"))
        if stop <= i + 1:
            continue
        apart = np.bitwise_count(maps[i + 1 : stop] ^ maps[i]).sum(axis=1, dtype=np.int64)
        total = size[i] + size[i + 1 : stop]
        overlap = (total - apart) // 2  # at most, since a differing place stands for a differing shingle
        near = np.flatnonzero((100 + num) * overlap >= num * total) + i + 1
        if across:
            near = near[block[near] != block[i]]
        for j in near:
            a, b = find(i), find(j)
            if a != b:
                shared = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if (100 + num) * shared >= num * (size[i] + size[j]):
                    root[max(a, b)] = min(a, b)
    found = np.array([find(k) for k in range(len(sets))], np.int64)
    moved = found != np.arange(len(sets))
    return forest(ids[moved], ids[found[moved]]) if moved.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _tiles(members: DataFrame, num: int) -> DataFrame:
    """(doc_id, tile, block) of the representatives of every group: a row for each tile that needs one."""
    # a little wider than the ratio of similar sizes, so that rounding never puts two bands between them
    bands = F.floor(F.log("n_shingles") / (1.0001 * math.log(100 / num))).cast("int")
    members = members.withColumn("band", bands)
    totals = members.groupBy("grp").agg(F.count("*").alias("sets"), F.sum("n_shingles").alias("total")).where("sets > 1")
    small = totals.where(f"sets <= {BLOCK_SETS} and total <= {BLOCK_SHINGLES}").select("grp")
    whole = members.join(small, "grp").select("doc_id", F.format_string("%d", "grp").alias("tile"), F.lit("").alias("block"))
    big = members.join(totals.where(f"sets > {BLOCK_SETS} or total > {BLOCK_SHINGLES}").select("grp"), "grp")
    cells = big.groupBy("grp", "band").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int").alias("n"))
    following = cells.select("grp", (F.col("band") - 1).alias("band"), F.col("n").alias("n_above"))
    before = cells.select("grp", (F.col("band") + 1).alias("band"), F.col("n").alias("n_below"))
    cells = cells.join(following, ["grp", "band"], "left").join(before, ["grp", "band"], "left").na.fill(0, ["n_above", "n_below"])
    own = big.join(cells, ["grp", "band"]).withColumn("k", F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int"))
    # A block meets every block of its band (itself too), of the next band and of the one before.
    same = "transform(sequence(0, n - 1), x -> format_string('%d:%d:%d:%d:%d', grp, band, least(k, x), band, greatest(k, x)))"
    above = "if(n_above = 0, cast(array() as array<string>), transform(sequence(0, greatest(n_above, 1) - 1), x -> format_string('%d:%d:%d:%d:%d', grp, band, k, band + 1, x)))"
    below = "if(n_below = 0, cast(array() as array<string>), transform(sequence(0, greatest(n_below, 1) - 1), x -> format_string('%d:%d:%d:%d:%d', grp, band - 1, x, band, k)))"
    parts = own.select("doc_id", F.format_string("%d:%d", "band", "k").alias("block"), F.explode(F.expr(f"concat({same}, {above}, {below})")).alias("tile"))
    return whole.unionByName(parts.select("doc_id", "tile", "block"))


def packed(own: np.ndarray) -> bytes:
    """The upper 40 bits of sorted hashes, which tell the shingles of two sets apart, in five bytes each."""
    short = own >> np.uint64(24)
    return short[np.diff(short, prepend=~short[:1]) != 0].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(blob, np.uint8).reshape(-1, 5)
    raw = np.concatenate([raw, np.zeros((len(raw), 3), np.uint8)], axis=1)
    return raw.view("<u8")[:, 0]


def _links(docs: DataFrame, tiles: DataFrame, n: int, num: int) -> DataFrame:
    """Verified links of the tiles, as a forest of each."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            blobs = pa.array([packed(shingles(t, n)) for t in bytes_of(batch)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), blobs], ["doc_id", "own"])
        _WORDS.clear()

    def run(_: tuple, rows: pa.Table) -> pa.Table:
        ids = rows.column("doc_id").to_numpy()
        block = np.unique(np.array(rows.column("block").to_pylist(), dtype=str), return_inverse=True)[1]
        own = [unpacked(x.as_buffer()) for x in rows.column("own")]
        del rows
        a, b = tile_links(ids, own, block, num)
        del own
        trim()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    reps = tiles.select("doc_id").distinct()
    own = docs.select("doc_id", "text").join(reps, "doc_id", "left_semi").mapInArrow(trimmed(sets), "doc_id long, own binary")
    # One row of a doc_id is enough: others of that id are members by their own sets.
    return tiles.join(own, "doc_id").groupBy("tile").applyInArrow(run, "a long, b long")


def classes(docs: DataFrame, n: int = 5, num: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: the smallest doc_id that links reach.

    `n` words make a shingle; two texts link when 100 * intersection >= num * union.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # a word for six bytes of text; a set has about 2.4 hashes for each shingle that a similar one may lack
    ranges = parts_for(n_bytes(docs) // 6 * 24 * (100 - num) // (10 * num), RANGE_HASHES)
    both = stored(_sets(docs, n, num, ranges), "sets")
    sets = both.where("at is null").select("doc_id", "n_shingles", "key_a", "key_b")
    sets = stored(sets, "sizes")
    rare = _rarest(both.where("at is not null"), SPLIT_HASHES, ranges)
    drop_stored(both)
    groups = connected(_group_links(rare, SPLIT_HASHES), "groups").withColumnRenamed("component", "grp")
    drop_stored(rare)
    grouped = groups.union(groups.select(F.col("grp").alias("node"), "grp").distinct())
    members = stored(sets.join(grouped, sets.doc_id == grouped.node).select("doc_id", "n_shingles", "key_a", "key_b", "grp"), "members")
    equal = members.groupBy("grp", "n_shingles", "key_a", "key_b").agg(F.min("doc_id").alias("rep"))
    tiles = stored(_tiles(equal.select(F.col("rep").alias("doc_id"), "n_shingles", "grp"), num), "tiles")
    links = _links(docs, tiles, n, num)
    copies = members.join(equal, ["grp", "n_shingles", "key_a", "key_b"]).where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    drop_stored(groups)
    found = connected(links.unionByName(copies), "links")
    drop_stored(members, tiles)
    out = sets.join(found, sets.doc_id == found.node, "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
