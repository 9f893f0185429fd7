"""Writers and sources read back: commits, refusals, checkpoints, manifests, JSON, evidence, heads, imports."""

import pytest

from ledgerline.operators import timeline
from ledgerline.sinks import output
from ledgerline.sinks.archive import Archive, Refused, Transaction, catalog_of
from ledgerline.sources import logs


def state(archive, seq=None):
    return {r.path: r.version for r in archive.snapshot(seq).collect()}


def test_a_scripted_history(spark, tmp_path):
    archive = Archive(spark, f"file://{tmp_path}/a")
    assert archive.head() is None and state(archive) == {}
    assert archive.commit(Transaction().put_dir("docs", 1).put_file("docs/a.txt", 2).put_file("empty", 3)) == 0
    assert archive.commit(Transaction().put_file("docs/a.txt", 4).put_file("docs/c.bin", 5).rename("empty", "docs/empty")) == 1
    assert archive.commit(Transaction().delete("docs/c.bin").put_file("big", 6).hold("keep", 1).expire(0)) == 2
    states = [{"docs": 1, "docs/a.txt": 2, "empty": 3}, {"docs": 1, "docs/a.txt": 4, "docs/c.bin": 5, "docs/empty": 3}, {"docs": 1, "docs/a.txt": 4, "docs/empty": 3, "big": 6}]
    assert [state(archive, k) for k in range(3)] == states
    for wrong in (Transaction().delete("gone"), Transaction().put_file("no/such", 9), Transaction().put_file("big/x", 9), Transaction().delete("docs"), Transaction().rename("gone", "x"), Transaction().expire(3), Transaction().hold("keep", 0), Transaction().release("other"), Transaction().expire(0), Transaction().hold("x", 4)):
        with pytest.raises(Refused):
            archive.commit(wrong)
    assert archive.head() == 2 and state(archive) == states[2]
    with pytest.raises(ValueError, match="no commit 7"):
        archive.snapshot(7)
    assert archive.checkpoint(1) == 1
    assert [state(archive, k) for k in range(3)] == states
    # what a writer has left that failed before its mark is not there
    archive.ops().limit(1).select("op_seq", "op", "path", "version", "kind").write.parquet(f"file://{tmp_path}/a/ops/commit_seq=3")
    assert state(archive) == states[2] and archive.commit(Transaction().delete("big")) == 3 and "big" not in state(archive)


def test_a_manifest_rebuilds_its_snapshot(spark, tmp_path):
    archive = Archive(spark, f"file://{tmp_path}/m")
    archive.commit(Transaction().put_file("a", 1).put_file("b", 2))
    archive.commit(Transaction().delete("b").put_file("c", 3))
    versions = spark.createDataFrame([(k, "file") for k in (1, 2, 3)], "version long, kind string")
    extents = spark.createDataFrame([(1, 0, 10), (2, 0, 20), (3, 0, 30), (3, 1, None)], "version long, ordinal long, chunk_id long")
    chunks = spark.createDataFrame([(10, 5), (20, 5), (30, 5)], "chunk_id long, bytes long")
    got = catalog_of(spark, archive.manifest(versions, extents, chunks), 1)
    assert {(r.path, r.version) for r in timeline.snapshot(got["namespace_ops"]).collect()} == {("a", 1), ("c", 3)}
    assert sorted(r.version for r in got["file_versions"].collect()) == [1, 3] and sorted(r.chunk_id for r in got["chunks"].collect()) == [10, 30]
    assert got["commits"].collect()[0].parent_seq is None
    with pytest.raises(Refused, match="chunk 30"):
        archive.manifest(versions, extents, chunks.where("chunk_id <> 30"))


def test_json_and_evidence(spark, tmp_path):
    table = spark.createDataFrame([(1, bytearray(b"\x00\xff"), None)], "k long, b binary, s string")
    assert output.rendered(table).first().json == '{"k":1,"b":{"blob_hex":"00ff"},"s":null}'
    output.write_json(table, f"file://{tmp_path}/json")
    assert spark.read.text(f"file://{tmp_path}/json").first().value.startswith('{"k":1')
    log = f"file://{tmp_path}/log"
    record = spark.createDataFrame([(1, 2, 3, "integrity", "verify", "PASS")], output.EVIDENCE)
    output.append_evidence(record, log)
    output.append_evidence(record.selectExpr("event_id + 1 as event_id", "seq", "completed", "dimension", "kind", "status"), log)
    (tmp_path / "log" / "torn.json").write_text('{"event_id": 9, "seq":\n{"event_id": 3, "kind": "verify"}\n')
    good, bad = logs.read_evidence(spark, log)
    assert sorted(r.event_id for r in good.collect()) == [1, 2] and bad.first().unreadable == 2


def test_heads_only_advance(spark):
    rows = lambda *x: spark.createDataFrame(x, "archive string, seq long, commit_id string")
    got = logs.merged_heads(rows(("a", 5, "x"), ("b", 2, "y")), rows(("a", 4, "z"), ("b", 3, "w"), ("c", 0, "v"), ("a", 5, "other")))
    assert sorted(map(tuple, got.collect())) == [("a", 5, "x"), ("b", 3, "w"), ("c", 0, "v")]


def test_import_lists_parents_first(spark, tmp_path):
    for name in ("b/x", "a", "b/c/y", "b.txt"):
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_text(name)
    rows = [(r.path, r.kind, r.length) for r in logs.import_scan(spark, f"{tmp_path}/t").collect()]
    assert rows == [("a", "file", 1), ("b", "directory", 0), ("b/c", "directory", 0), ("b/c/y", "file", 5), ("b/x", "file", 3), ("b.txt", "file", 5)]
    with pytest.raises(ValueError, match="more than 3 bytes"):
        logs.import_scan(spark, f"{tmp_path}/t", most=3)
