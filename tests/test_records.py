"""Stored manifests, catalog images and streams: what holds is read, what does not is refused."""

import hashlib

import pytest

from ledgerline.functions import codecs
from ledgerline.sources import records

MANIFEST = {"seq": 3, "parent": (2, b"h" * 32), "kind": "delta", "chunks": [(b"b", 5), (b"a", 7)], "versions": [(1, "file", 12)], "ops": [("put", "docs/a", 1), ("delete", "b", None)], "features": [1]}
digest = lambda x: hashlib.sha256(x).digest()


def test_manifests(spark):
    stored = records.write_manifest(MANIFEST)
    found = records.read_manifest(stored, digest(stored), 3)
    assert found["chunks"] == [[b"a", 7], [b"b", 5]] and found["parent"] == [2, b"h" * 32] and found["ops"][1] == ["delete", "b", None]
    with pytest.raises(codecs.Fault, match="introduced_twice"):
        records.write_manifest({**MANIFEST, "versions": [(1, "file", 12), (1, "file", 12)]})
    cases = {"stored_integrity": (stored, digest(b"x"), 3), "other_commit": (stored, digest(stored), 4)}
    for fault, body in (("unsupported_feature", {**MANIFEST, "features": [9]}), ("record_invalid", {**MANIFEST, "kind": "other"})):
        raw = records.write_manifest(body)
        cases[fault] = (raw, digest(raw), 3)
    raw = codecs.zstd_encode(codecs.cbor_encode({k: [] for k in range(9)}))
    cases["malformed"] = (b"junk", digest(b"junk"), 3)
    for fault, args in cases.items():
        with pytest.raises(codecs.Fault, match=fault):
            records.read_manifest(*args)
    with pytest.raises(codecs.Fault, match="record_invalid"):
        records.read_manifest(raw, digest(raw))
    table = spark.createDataFrame([(3, bytearray(digest(stored)), bytearray(stored)), (4, bytearray(digest(stored)), bytearray(stored)), (5, bytearray(b"x"), bytearray(stored))], "seq long, digest binary, content binary")
    got = [tuple(r) for r in records.manifest_ops(table).orderBy("seq", "op_seq").collect()]
    assert got == [(3, "delta", None, 0, "put", "docs/a", 1), (3, "delta", None, 1, "delete", "b", None), (4, None, "other_commit", None, None, None, None), (5, None, "stored_integrity", None, None, None, None)]


def image():
    con = records.new_catalog()
    a, h = b"a" * 32, b"h" * 32
    con.execute("INSERT INTO commits VALUES (0, NULL)")
    con.execute("INSERT INTO objects VALUES (?, 5, ?)", (a, h))
    con.execute("INSERT INTO chunks VALUES (?, 'zstd-frame', 'none', 9, ?)", (a, h))
    con.execute("INSERT INTO file_versions VALUES (?, 'file', 9, ?)", (h, h))
    con.execute("INSERT INTO file_extents VALUES (?, 0, 0, 9, ?, 0)", (h, a))
    con.execute("INSERT INTO namespace_ops VALUES (0, 0, 'put', ?, ?)", (b"p", h))
    return con


def test_images(spark, tmp_path):
    whole = records.publish(image())
    assert records.open_image(whole).execute("SELECT path FROM namespace_ops").fetchall() == [(b"p",)]
    con = image()
    with pytest.raises(Exception, match="CHECK"):
        con.execute("INSERT INTO namespace_ops VALUES (0, 1, 'delete', ?, ?)", (b"p", b"h" * 32))
    con.execute("CREATE INDEX extra ON commits (parent_seq)")
    with pytest.raises(codecs.Fault, match="schema"):
        records.publish(con)
    con = image()
    con.commit()
    con.execute("PRAGMA foreign_keys = OFF")
    con.execute("DELETE FROM objects")
    with pytest.raises(codecs.Fault, match="foreign_key"):
        records.publish(con)
    broken = bytearray(whole)
    broken[4096 * 2 : 4096 * 2 + 200] = b"\xff" * 200
    other = bytearray(whole)
    other[63] = 9
    files = spark.createDataFrame([("a", bytearray(whole)), ("b", bytearray(other)), ("c", bytearray(broken))], "path string, content binary")
    got = {(r.path, r.table_name): (r.row_count, r.fault) for r in records.image_counts(files).collect()}
    assert got["a", "commits"] == (1, None) and got["a", "object_locations"] == (0, None) and len([k for k in got if k[0] == "a"]) == 9
    assert got["b", None] == (None, "not_a_catalog") and got["c", None][1] in ("integrity", "schema")


def test_streams_are_their_puts():
    puts = [(codecs.Member(b"d", True, mode=0o755), b""), (codecs.Member(b"d/a", size=3), b"abc"), (codecs.Member(b"e"), b"")]
    assert records.stream_faults(codecs.tar_stream(puts), puts) == [] == records.stream_faults(codecs.END, [])
    assert records.stream_faults(codecs.tar_stream(puts[:2]), puts) == [(2, "missing_member")]
    assert records.stream_faults(codecs.tar_stream(puts), puts[:2]) == [(2, "additional_member")]
    assert records.stream_faults(codecs.tar_stream([puts[0], (puts[1][0], b"abd"), puts[2]]), puts) == [(1, "other_content")]
    assert records.stream_faults(codecs.tar_stream([puts[0], puts[2], puts[1]]), puts) == [(1, "other_member"), (2, "other_member")]
    assert records.stream_faults(codecs.tar_stream(puts)[:-1], puts) == [(2, "bad_end")]
