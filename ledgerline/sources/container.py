"""Archives as files: back-to-back frames, the footer at their end, the head, and what follows it.

A frame's length comes from walking its bytes, so one file is one task's; files are walked side by side. The
binary source hands a task a file of at most 2 GB.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# The magic number of data frames, the first and last of the frames that readers skip, and kinds of these.
DATA, FIRST, LAST = 0xFD2FB528, 0x184D2A50, 0x184D2A5F
KINDS = {0x184D2A50: "metadata", 0x184D2A51: "commit", 0x184D2A52: "prepared", 0x184D2A54: "signature", 0x184D2A55: "search", 0x184D2A56: "footer", 0x184D2A57: "descriptor", 0x184D2A58: "manifest", 0x184D2A59: "encrypted", 0x184D2A5C: "key", 0x184D2A5D: "dictionary", 0x184D2A5E: "history", 0x184D2A5F: "parity"}
HEADER, FOOTER = 8, 72
MOST_BLOCK = 128 << 10


def sha(prefix: bytes, commit: bytes) -> bytes:
    return hashlib.sha256(prefix + commit).digest()


@dataclass(frozen=True)
class Layout:
    """What a family of archives has of its own: the eight bytes that begin a footer's payload, the digest of a
    footer's first 32 bytes and its commit frame, and limits."""

    mark: bytes = b"LEDGER\0\0"
    digest: Callable[[bytes, bytes], bytes] = sha
    most_payload: int = 1 << 30
    most_window: int = 1 << 27


@dataclass(frozen=True)
class Frame:
    offset: int
    size: int
    magic: int
    kind: str
    content_size: int | None = None


class Broken(ValueError):
    """Bytes that are no frame; the message says why."""


def walk(data: bytes, at: int, layout: Layout) -> Frame:
    """The frame at an offset, by its structure alone."""
    need = lambda a, n: data[a : a + n] if a + n <= len(data) else _cut()
    magic = int.from_bytes(need(at, 4), "little")
    if KINDS.get(magic) == "descriptor" and at:
        raise Broken("misplaced")
    if FIRST <= magic <= LAST:
        size = int.from_bytes(need(at + 4, 4), "little")
        if size > layout.most_payload:
            raise Broken("limit_exceeded")
        need(at + HEADER, size)
        return Frame(at, HEADER + size, magic, KINDS.get(magic, "reserved"))
    if magic != DATA:
        raise Broken("not_a_frame")
    flags = need(at + 4, 1)[0]
    if flags & 8:
        raise Broken("reserved_bit")
    pos, single = at + 5, bool(flags & 32)
    window = None
    if not single:
        base = 1 << (10 + (need(pos, 1)[0] >> 3))
        window, pos = base + base // 8 * (data[pos] & 7), pos + 1
    pos += (0, 1, 2, 4)[flags & 3]
    width = (int(single), 2, 4, 8)[flags >> 6]
    content = int.from_bytes(need(pos, width), "little") + 256 * (width == 2) if width else None
    pos += width
    window = content if window is None else window
    if window > layout.most_window:
        raise Broken("limit_exceeded")
    last = False
    while not last:
        word = int.from_bytes(need(pos, 3), "little")
        last, kind, size = bool(word & 1), word >> 1 & 3, word >> 3
        if kind == 3:
            raise Broken("reserved_block")
        if size > min(window, MOST_BLOCK):
            raise Broken("block_too_large")
        need(pos + 3, 1 if kind == 1 else size)
        pos += 3 + (1 if kind == 1 else size)
    if flags & 4:
        need(pos, 4)
        pos += 4
    return Frame(at, pos - at, magic, "data", content)


def _cut() -> bytes:
    raise Broken("truncated")


def frames(data: bytes, layout: Layout, at: int = 0) -> Iterator[tuple[Frame | None, str | None, int]]:
    """(frame, fault, offset) one after another; the first fault ends it, as what follows has no known place."""
    while at < len(data):
        try:
            frame = walk(data, at, layout)
        except Broken as why:
            yield None, str(why), at
            return
        yield frame, None, at
        at += frame.size


@dataclass(frozen=True)
class Footer:
    offset: int
    seq: int
    commit_offset: int
    commit_len: int


def write_footer(commit: bytes, commit_offset: int, seq: int, layout: Layout) -> bytes:
    prefix = layout.mark + b"".join(n.to_bytes(8, "little") for n in (commit_offset, len(commit), seq))
    return (0x184D2A56).to_bytes(4, "little") + (FOOTER - HEADER).to_bytes(4, "little") + prefix + layout.digest(prefix, commit)


def footer_at(data: bytes, at: int, layout: Layout) -> Footer | None:
    """The footer at an offset, if it is whole: its header, its mark, a commit frame of the length it says
    before it, and the digest of both."""
    raw = data[at : at + FOOTER] if at >= 0 else b""
    if len(raw) < FOOTER or raw[:16] != write_footer(b"", 0, 0, layout)[:16]:
        return None
    offset, size, seq = (int.from_bytes(raw[k : k + 8], "little") for k in (16, 24, 32))
    if size < HEADER or offset + size > at:
        return None
    try:
        frame = walk(data, offset, layout)
    except Broken:
        return None
    commit = data[offset : offset + size]
    if frame.size != size or frame.kind != "commit" or raw != write_footer(commit, offset, seq, layout):
        return None
    return Footer(at, seq, offset, size)


def locate(data: bytes, layout: Layout) -> tuple[Footer | None, str]:
    """The head's footer and where it was found: at the end of the file, or the last whole one of a scan."""
    at_end = footer_at(data, len(data) - FOOTER, layout)
    if at_end:
        return at_end, "eof"
    best = None
    for frame, _, at in frames(data, layout):
        if frame and frame.kind == "footer" and frame.size == FOOTER:
            best = footer_at(data, at, layout) or best
    return best, "scan"


def tail_state(data: bytes, begin: int, layout: Layout) -> tuple[str, str | None]:
    """clean, uncommitted or unresolved, with the reason for the last: what follows the head can be cut off only
    if it is whole frames, the last perhaps cut short, and no whole footer and no descriptor can lie in it."""
    if begin >= len(data):
        return "clean", None
    known = write_footer(b"", 0, 0, layout)[:16]
    last = len(data) - FOOTER
    if last >= begin and data.find(known[:8], begin, last + 8) >= 0:
        return "unresolved", "footer_header"
    if last >= begin and data.find(known[8:], max(begin, HEADER), last + 16) >= 0:
        return "unresolved", "footer_mark"
    for frame, fault, _ in frames(data, layout, begin):
        if frame and frame.kind in ("footer", "descriptor"):
            return "unresolved", f"{frame.kind}_frame"
        if fault == "misplaced":
            return "unresolved", "descriptor_frame"
        if fault and fault != "truncated":
            return "unresolved", fault
    return "uncommitted", None


def _each(spark: SparkSession, folder: str, one: Callable[[str, bytes], list[tuple]], schema: str) -> DataFrame:
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string()}[x.split()[1]] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows = list(zip(*one(path, data.as_py()), strict=True)) or [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select("path", "content").mapInArrow(run, schema)


def scan_frames(spark: SparkSession, folder: str, layout: Layout = Layout()) -> DataFrame:  # noqa: B008
    """path, offset, size, kind, content_size, fault of every frame of the files below a folder."""

    def one(path: str, data: bytes) -> list[tuple]:
        return [(path, at, f.size if f else None, f.kind if f else None, f.content_size if f else None, fault) for f, fault, at in frames(data, layout)]

    return _each(spark, folder, one, "path string, offset long, size long, kind string, content_size long, fault string")


def scan_heads(spark: SparkSession, folder: str, layout: Layout = Layout()) -> DataFrame:  # noqa: B008
    """path, seq, footer_offset, commit_offset, committed_len, source, tail, reason: the head of every file; seq is
    null where nothing was committed."""

    def one(path: str, data: bytes) -> list[tuple]:
        head, source = locate(data, layout)
        if head is None:
            return [(path, None, None, None, 0, source, *tail_state(data, 0, layout))]
        return [(path, head.seq, head.offset, head.commit_offset, head.offset + FOOTER, source, *tail_state(data, head.offset + FOOTER, layout))]

    return _each(spark, folder, one, "path string, seq long, footer_offset long, commit_offset long, committed_len long, source string, tail string, reason string")
