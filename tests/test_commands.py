"""Commands over a small archive with a known history."""

import pytest

from ledgerline import commands
from ledgerline.operators import search, timeline


@pytest.fixture(scope="module")
def archive(spark):
    """0: docs/, docs/a, b; 1: docs/a anew; 2: c, b goes; 3: retention alone. Chunk 40 belongs to nothing."""
    frame = spark.createDataFrame
    ops = [(0, 0, "put", "docs", 1), (0, 1, "put", "docs/a", 2), (0, 2, "put", "b", 3), (1, 0, "put", "docs/a", 4), (2, 0, "put", "c", 5), (2, 1, "delete", "b", None)]
    versions = [(1, "directory", 0, None), *[(k, "file", 150, f"h{k}") for k in (2, 3, 4, 5)]]
    extents = [(k, 0, 0, 150, k * 10, 0) for k in (2, 3, 4, 5)]
    kept = [(1, 3, "expire", 0, None), (2, 3, "expire", 1, None), (3, 3, "hold", 1, "keep"), (4, 3, "hold", 0, "x"), (5, 3, "release", None, "x")]
    return commands.Relations(
        frame([(0, None), (1, 0), (2, 1), (3, 2)], "seq long, parent_seq long"),
        frame(ops, "seq long, op_seq long, op string, path string, version long"),
        frame(versions, "version long, kind string, logical_len long, content_hash string"),
        frame(extents, "version long, ordinal long, logical_offset long, length long, chunk_id long, chunk_offset long"),
        frame([(k, 150, 100 + k) for k in (20, 30, 40, 50)] + [(60, 150, 7)], "chunk_id long, decoded_len long, bytes long"),
        frame(kept, "op_id long, seq long, kind string, target long, label string"),
        frame([], "chunk_id long, dependency_id long"),
    )


def test_list_search_and_snapshots(archive):
    assert [r.path for r in commands.listed(archive, "docs").collect()] == ["docs", "docs/a"]
    assert [r.path for r in commands.listed(archive, seq=0).collect()] == ["b", "docs", "docs/a"]
    with pytest.raises(ValueError, match="no commit 9"):
        commands.listed(archive, seq=9)
    hits, coverage = commands.found(archive, search.Query(text="A", fold=True, kind="file"), "all")
    assert [(r.seq, r.path, r.version) for r in hits.collect()] == [(0, "docs/a", 2), (1, "docs/a", 4), (2, "docs/a", 4), (3, "docs/a", 4)]
    assert (coverage.first().requested, coverage.first().searched) == (4, 4)
    hits, coverage = commands.found(archive, search.Query(content_hash="h3"), [0, 2, 8])
    assert [(r.seq, r.path) for r in hits.collect()] == [(0, "b")] and coverage.first().unavailable == [8]
    assert commands.found(archive, search.Query(), "retained")[1].first().entries_examined == 9
    assert [tuple(r) for r in commands.snapshots(archive).collect()] == [(0, False, []), (1, True, ["keep"]), (2, True, []), (3, True, [])]


def test_restore_plan(archive):
    rows = commands.restore_plan(archive, ["docs/a"]).collect()
    assert [(r.path, r.kind) for r in rows] == [("docs", "directory"), ("docs/a", "file")] and rows[1].slices[0].chunk_id == 40
    with pytest.raises(ValueError, match="no entry b"):
        commands.restore_plan(archive, ["b"])


def test_verify_and_health(archive, spark):
    found, verdict = commands.verified(archive)
    assert found.count() == 0 and verdict.first().violations == 0
    evidence = spark.createDataFrame([(1, 3, 50, "integrity", "verify", "PASS"), (2, 3, 50, "recoverability", "restore_test", "PASS")], "event_id long, seq long, completed long, dimension string, kind string, status string")
    row = commands.judged(evidence, 60, 3, {}, ["integrity", "recoverability"]).first()
    assert (row.policy_result, row.exit_code, row.overall_status) == ("PASS", 0, "UNSUPPORTED")
    row = commands.judged(evidence, 60, 3, {}, ["integrity"], fresh="FAIL").first()
    assert (row.policy_result, row.exit_code) == ("FAIL", 1)


def test_collection_and_rewrite(archive, spark):
    plan = commands.collection(archive, streams=True)
    assert [tuple(r) for r in plan.snapshots.collect()] == [(0, "expired; not the head; no active hold")]
    assert [r.version for r in plan.versions.collect()] == [2] and [r.chunk_id for r in plan.chunks.collect()] == [20]
    got = {(r.kind, r["class"]): (r.n, r.bytes) for r in plan.totals.collect()}
    assert got == {("version", "retained"): (4, 0), ("version", "collectable"): (1, 0), ("chunk", "retained"): (3, 420), ("chunk", "collectable"): (1, 120), ("chunk", "stream_framing"): (1, 7)}
    rewrite = commands.compacted(archive)
    assert commands.rewrite_differences(archive, rewrite).count() == 0
    assert {tuple(r) for r in rewrite.retention.collect()} == {("hold", "keep", 1, 0), ("expire", None, 1, 0)}
    assert [r.seq for r in rewrite.collected.collect()] == [0] and rewrite.versions.count() == 4 and rewrite.chunks.count() == 3
    assert commands.rewrite_differences(archive, commands.compacted(archive, everything=True)).count() == 0
    bound = commands.Relations(**{**vars(archive), "dependencies": spark.createDataFrame([(40, 1)], "chunk_id long, dependency_id long")})
    with pytest.raises(NotImplementedError, match="chunk 40"):
        commands.collection(bound)


def test_repair(archive, spark):
    catalogs = spark.createDataFrame([(c, s, c != 3) for c in range(4) for s in range(c + 1) if s != 0], "catalog_seq long, seq long, opens boolean")
    errors = spark.createDataFrame([(3, "CATALOG_INVALID")], "seq long, code string")
    promised = spark.createDataFrame([(k, "m") for k in (1, 2, 3, 5)] + [(5, "n")], "version long, attributes string")
    plan = commands.repair_plan(archive, catalogs, errors, promised, spark.createDataFrame([(3,)], "version long"), 1)
    assert {(r.seq, r.catalog_seq) for r in plan.supplied.collect()} == {(1, 2), (2, 2)}
    assert {tuple(r) for r in plan.lost.collect()} == {(0, "below the chain break"), (3, "CATALOG_INVALID")}
    assert {tuple(r) for r in plan.bad.collect()} == {(3, "content"), (4, "no_attributes"), (5, "attribute_conflict")}
    assert {(r.path, r.reason, tuple(r.snapshots)) for r in plan.omitted.collect()} == {("b", "content", (1,)), ("c", "attribute_conflict", (2,)), ("docs/a", "no_attributes", (1, 2))}
    assert tuple(plan.outcome.first()) == ("partial", 2)
    assert {tuple(r) for r in commands.repaired(archive, plan).collect()} == {(0, "docs", 1), (1, "docs", 1)}


def test_states_and_dumps(archive, spark):
    assert commands.state_differences(archive, archive).count() == 0
    other = commands.Relations(**{**vars(archive), "chunks": archive.chunks.where("chunk_id <> 20"), "ops": archive.ops.where("path <> 'c'")})
    assert [tuple(r) for r in commands.state_differences(archive, other).collect()] == [("namespace", "c", "missing_right"), ("chunks", "20", "missing_right")]
    counts, rows = commands.dumped({"commits": archive.commits, "chunks": archive.chunks})
    assert [tuple(r) for r in counts.collect()] == [("chunks", 5), ("commits", 4)] and [r.seq for r in rows["commits"].collect()] == [0, 1, 2, 3]
    assert timeline.snapshot(archive.ops).count() == 3
    for name in commands.STUBS:
        with pytest.raises(NotImplementedError, match="exit code 4"):
            commands.unsupported(name)
