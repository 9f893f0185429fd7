"""Stored records as rows: manifests in canonical CBOR, catalogs as SQLite images, and TAR streams of commits.

A record is known by the digest of its stored bytes and is never parsed before that holds.
"""

from __future__ import annotations

import hashlib
import sqlite3
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerline.functions import codecs
from ledgerline.functions.codecs import Fault

# The keys of a manifest's map and of its parts.
SEQ, PARENT, KIND, CHUNKS, VERSIONS, OPS, FEATURES = range(7)
FEATURES_KNOWN = (1, 2, 3)


def write_manifest(manifest: dict) -> bytes:
    """The stored form of a manifest: seq, parent (seq, hash) or None, kind, chunks (id, stored_len), versions
    (id, kind, logical_len), ops (op, path, version), features. Arrays are in the order of their ids."""
    unique = lambda rows: sorted(rows) if len({r[0] for r in rows}) == len(rows) else _twice()
    body = {
        SEQ: manifest["seq"],
        PARENT: list(manifest["parent"]) if manifest["parent"] else None,
        KIND: manifest["kind"],
        CHUNKS: [list(r) for r in unique(manifest["chunks"])],
        VERSIONS: [list(r) for r in unique(manifest["versions"])],
        OPS: [list(r) for r in manifest["ops"]],
        FEATURES: sorted(manifest["features"]),
    }
    return codecs.zstd_encode(codecs.cbor_encode(body))


def _twice() -> list:
    raise Fault("introduced_twice")


def read_manifest(stored: bytes, digest: bytes, seq: int | None = None, most: int = 1 << 28) -> dict:
    """The manifest of these bytes, which must have the digest, be canonical, have no unknown key, and belong to
    the commit that names it."""
    if hashlib.sha256(stored).digest() != digest:
        raise Fault("stored_integrity")
    import zstandard

    try:
        size = zstandard.frame_content_size(stored)
    except zstandard.ZstdError:
        raise Fault("malformed") from None
    if not 0 <= size <= most:
        raise Fault("limit_exceeded")
    body = codecs.cbor_decode(codecs.zstd_decode(stored, size))
    if not isinstance(body, dict) or set(body) != set(range(7)):
        raise Fault("record_invalid")
    if body[KIND] not in ("delta", "snapshot") or not isinstance(body[SEQ], int):
        raise Fault("record_invalid")
    if any(f not in FEATURES_KNOWN for f in body[FEATURES]):
        raise Fault("unsupported_feature")
    for rows in (body[CHUNKS], body[VERSIONS]):
        if any(a[0] >= b[0] for a, b in zip(rows, rows[1:], strict=False)):
            raise Fault("not_canonical")
    if seq is not None and body[SEQ] != seq:
        raise Fault("other_commit")
    names = {"seq": SEQ, "parent": PARENT, "kind": KIND, "chunks": CHUNKS, "versions": VERSIONS, "ops": OPS, "features": FEATURES}
    return {n: body[k] for n, k in names.items()}


OPS_OF = "seq long, kind string, fault string, op_seq long, op string, path string, version long"


def manifest_ops(stored: DataFrame) -> DataFrame:
    """OPS_OF of every operation of stored manifests (seq, digest, content); one row with the fault of each that
    is refused."""
    names = [x.split()[0] for x in OPS_OF.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for seq, digest, content in zip(*(batch.column(c).to_pylist() for c in ("seq", "digest", "content")), strict=True):
                try:
                    found = read_manifest(content, digest, seq)
                except Fault as why:
                    out.append((seq, None, str(why), None, None, None, None))
                    continue
                out += [(seq, found["kind"], None, k, op, path, version) for k, (op, path, version) in enumerate(found["ops"])]
            cols = list(zip(*out, strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return stored.select("seq", "digest", "content").mapInArrow(run, OPS_OF)


# Catalog images

APPLICATION, VERSION = 0x4C444752, 1
_ID = "BLOB NOT NULL CHECK (length({0}) = 32)"
TABLES = {
    "archive_meta": "key TEXT PRIMARY KEY, value BLOB NOT NULL",
    "commits": "seq INTEGER PRIMARY KEY CHECK (seq >= 0), parent_seq INTEGER REFERENCES commits (seq) CHECK (parent_seq < seq)",
    "objects": f"object_id {_ID.format('object_id')} PRIMARY KEY, stored_len INTEGER NOT NULL CHECK (stored_len > 0), stored_hash {_ID.format('stored_hash')}",
    "object_locations": "object_id BLOB PRIMARY KEY REFERENCES objects (object_id), stored_offset INTEGER NOT NULL CHECK (stored_offset >= 0)",
    "chunks": f"object_id BLOB PRIMARY KEY REFERENCES objects (object_id), encoding TEXT NOT NULL, protection TEXT NOT NULL CHECK (protection IN ('none', 'aead')), decoded_len INTEGER NOT NULL, content_hash {_ID.format('content_hash')}",
    "chunk_dependencies": "object_id BLOB NOT NULL REFERENCES chunks (object_id), dependency_kind TEXT NOT NULL, dependency_id BLOB NOT NULL, PRIMARY KEY (object_id, dependency_kind, dependency_id)",
    "file_versions": f"file_version_id {_ID.format('file_version_id')} PRIMARY KEY, kind TEXT NOT NULL CHECK (kind IN ('file', 'directory')), logical_len INTEGER NOT NULL, content_hash BLOB, CHECK ((kind = 'file') = (content_hash IS NOT NULL)), CHECK (kind = 'file' OR logical_len = 0)",
    "file_extents": "file_version_id BLOB NOT NULL REFERENCES file_versions (file_version_id), ordinal INTEGER NOT NULL, logical_offset INTEGER NOT NULL, length INTEGER NOT NULL CHECK (length > 0), chunk_id BLOB REFERENCES chunks (object_id), chunk_offset INTEGER NOT NULL, PRIMARY KEY (file_version_id, ordinal), CHECK (chunk_id IS NOT NULL OR chunk_offset = 0)",
    "namespace_ops": "commit_seq INTEGER NOT NULL REFERENCES commits (seq), op_seq INTEGER NOT NULL, op TEXT NOT NULL CHECK (op IN ('put', 'delete')), path BLOB NOT NULL CHECK (length(path) > 0), file_version_id BLOB REFERENCES file_versions (file_version_id), PRIMARY KEY (commit_seq, op_seq), CHECK ((op = 'put') = (file_version_id IS NOT NULL))",
}


def new_catalog() -> sqlite3.Connection:
    """An empty catalog in memory, with its keys enforced."""
    con = sqlite3.connect(":memory:")
    con.execute("PRAGMA foreign_keys = ON")
    con.execute(f"PRAGMA application_id = {APPLICATION}")
    con.execute(f"PRAGMA user_version = {VERSION}")
    for name, columns in TABLES.items():
        con.execute(f"CREATE TABLE {name} ({columns}) STRICT" + ", WITHOUT ROWID" * (name not in ("commits",)))
    return con


def publish(con: sqlite3.Connection) -> bytes:
    """The image of a catalog that holds: checked, compacted, serialised."""
    con.commit()
    _check(con)
    con.execute("VACUUM")
    return con.serialize()


def _check(con: sqlite3.Connection) -> None:
    schema = "SELECT type, name, tbl_name, sql FROM sqlite_schema ORDER BY name"
    if con.execute(schema).fetchall() != new_catalog().execute(schema).fetchall():
        raise Fault("schema")
    if con.execute("PRAGMA integrity_check").fetchall() != [("ok",)]:
        raise Fault("integrity")
    if con.execute("PRAGMA foreign_key_check").fetchall():
        raise Fault("foreign_key")


def open_image(image: bytes) -> sqlite3.Connection:
    """The catalog of an image: of this kind and version, of exactly the known schema, whole, with its keys."""
    if image[:16] != b"SQLite format 3\0" or int.from_bytes(image[68:72], "big") != APPLICATION or int.from_bytes(image[60:64], "big") != VERSION:
        raise Fault("not_a_catalog")
    con = sqlite3.connect(":memory:")
    try:
        con.deserialize(image)
        _check(con)
    except sqlite3.DatabaseError:
        raise Fault("integrity") from None
    return con


COUNTS = "path string, table_name string, row_count long, fault string"


def image_counts(files: DataFrame) -> DataFrame:
    """COUNTS of every relation of images (path, content); one row with the fault of each that does not open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    con = open_image(content)
                except Fault as why:
                    out.append((path, None, None, str(why)))
                    continue
                out += [(path, name, con.execute(f"SELECT count(*) FROM {name}").fetchone()[0], None) for name in TABLES]
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * 4, kinds, strict=True)], [x.split()[0] for x in COUNTS.split(", ")])

    return files.select("path", "content").mapInArrow(run, COUNTS)


# Streams


def stream_faults(stream: bytes, puts: list[tuple[codecs.Member, bytes]]) -> list[tuple[int, str]]:
    """(place, fault) where a commit's stream is not its puts, in order, member for member."""
    out: list[tuple[int, str]] = []
    found = codecs.tar_members(stream)
    place = 0
    try:
        for place, (member, content) in enumerate(found):
            if place >= len(puts):
                out.append((place, "additional_member"))
            elif member != puts[place][0]:
                out.append((place, "other_member"))
            elif content != puts[place][1]:
                out.append((place, "other_content"))
    except Fault as why:
        return [*out, (place, str(why))]
    return out + [(k, "missing_member") for k in range(place + 1 if stream.strip(b"\0") else 0, len(puts))]
