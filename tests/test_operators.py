"""Operators against independent models, defect by defect."""

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerline.functions import paths, text
from ledgerline.operators import audit, extents, health, recovery, retention, segments, timeline

OPS = "seq long, op_seq long, op string, path string, version long"


def ops_of(history):
    return [(seq, k, op, path, seq * 100 + k) for seq, commit in enumerate(history) for k, (op, path) in enumerate(commit)]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["put", "delete"]), st.sampled_from(["a", "b", "a/c", "a/c/d"])), max_size=5), min_size=1, max_size=6))
def test_intervals_equal_a_fold(spark, history):
    state, expected, faults = {}, set(), 0
    for seq, commit in enumerate(history):
        for k, (op, path) in enumerate(commit):
            if op == "put":
                state[path] = seq * 100 + k
            else:
                faults += path not in state
                state.pop(path, None)
        expected |= {(seq, p, v) for p, v in state.items()}
    ops = spark.createDataFrame(ops_of(history), OPS)
    log = timeline.valid_log(ops)
    live = timeline.in_snapshots(timeline.intervals(log), len(history) - 1)
    assert {(r.seq, r.path, r.version) for r in live.collect()} == expected
    assert timeline.delete_faults(ops).count() == faults
    for head in sorted({0, len(history) // 2, len(history) - 1}):
        entries = timeline.intervals(ops)
        upto = {x for x in expected if x[0] <= head}
        assert {(r.seq, r.path, r.version) for r in timeline.in_snapshots(entries, head).collect()} == upto
        wanted = spark.range(0, len(history), 2).withColumnRenamed("id", "seq")
        some = {x for x in upto if x[0] % 2 == 0}
        assert {(r.seq, r.path, r.version) for r in timeline.in_snapshots(entries, head, wanted).collect()} == some
        assert {(r.path, r.version) for r in timeline.seen_by(entries, head, wanted).collect()} == {x[1:] for x in some}
        got = {r.seq: (r.entries, r.versions) for r in timeline.counts(entries, head).collect()}
        assert got == {s: (len([x for x in upto if x[0] == s]), len({x[2] for x in upto if x[0] == s})) for s in {x[0] for x in upto}}
    middle = len(history) // 2
    assert {(middle, r.path, r.version) for r in timeline.snapshot(log, middle).collect()} == {x for x in expected if x[0] == middle}


INTERVALS = st.lists(st.tuples(st.sampled_from("ab"), st.integers(1, 2), st.integers(0, 5), st.none() | st.integers(1, 6)).filter(lambda x: x[3] is None or x[2] < x[3]), max_size=6)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(INTERVALS, INTERVALS, st.sets(st.integers(0, 6), min_size=1))
def test_entries_differ_as_their_snapshots_do(spark, left, right, seqs):
    sides = [spark.createDataFrame(rows, "path string, version long, live_from long, live_to long") for rows in (left, right)]
    wanted = spark.createDataFrame([(k,) for k in sorted(seqs)], "seq long")
    want = timeline.differing_snapshots(*[timeline.in_snapshots(x, 6, wanted) for x in sides])
    assert {tuple(r) for r in timeline.differing_entries(*sides, wanted).collect()} == {tuple(r) for r in want.collect()}


def test_diff_turns_one_snapshot_into_the_other(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "path string, version long")
    b = spark.createDataFrame([("x", 1), ("y", 5), ("w", 4)], "path string, version long")
    both = timeline.joined(a, b)
    assert [tuple(r) for r in timeline.in_order(timeline.diff(both)).collect()] == [("z", "delete", None), ("w", "put", 4), ("y", "put", 5)]
    assert {tuple(r) for r in timeline.state_differences(both).collect()} == {("y", "changed"), ("z", "missing_right"), ("w", "missing_left")}


def test_extent_defects_in_order(spark):
    rows = [
        (1, 0, 0, 5), (1, 1, 5, 5),  # sound
        (2, 0, 0, 5), (2, 2, 5, 5),  # ordinals
        (3, 0, 0, 0),  # empty
        (4, 0, 0, 5), (4, 1, 6, 5),  # gap
        (5, 0, 0, 5), (5, 1, 4, 5),  # overlap
        (6, 0, 0, 5),  # length
    ]
    ext = spark.createDataFrame(rows, "version long, ordinal long, logical_offset long, length long")
    versions = spark.createDataFrame([(k, 10) for k in range(1, 8)], "version long, logical_len long")
    found = {r.version: r.defect for r in extents.defects(ext, versions, "ordinal").collect()}
    assert found == {2: "ordinal_sequence", 3: "empty", 4: "gap", 5: "overlap", 6: "length_mismatch", 7: "length_mismatch"}


def test_extent_defects_that_chunks_show(spark):
    most = (1 << 63) - 1
    rows = [
        (1, 0, 0, 10, 7, 90), (2, 0, 0, 10, 7, 91), (3, 0, 0, 10, 8, 0), (4, 0, 0, most, 7, 1), (5, 0, 0, most, None, 0), (5, 1, most, 5, None, 0),
        (6, 0, 0, 10, None, 0), (6, 1, 10, 1000, None, 0), (6, 2, 1010, 90, 7, 10),
    ]
    ext = spark.createDataFrame(rows, "version long, ordinal long, logical_offset long, length long, chunk_id long, chunk_offset long")
    versions = spark.createDataFrame([(1, 10), (2, 10), (3, 10), (4, most), (5, 7), (6, 1100), (7, 0)], "version long, logical_len long")
    chunks = spark.createDataFrame([(7, 100)], "chunk_id long, decoded_len long")
    found = {r.version: r.defect for r in extents.defects(ext, versions, "ordinal", chunks).collect()}
    assert found == {2: "out_of_range", 3: "unknown_chunk", 4: "overflow", 5: "overflow"}


def test_a_chunk_stays_loaded_until_another_is_read(spark):
    for chunks, loads in (([7, 7, 8, 7, None], 3), ([7, None, 7], 1), ([None, None], 0), ([7, None, 8, None, 8], 2)):
        ext = spark.createDataFrame([(1, k, c) for k, c in enumerate(chunks)], "version long, ordinal long, chunk_id long")
        assert extents.loads(ext).first().loads == loads


def test_reassembly_fills_holes_and_compares(spark):
    pieces = spark.createDataFrame([(1, 0, "ab", 2), (1, 1, None, 3), (1, 2, "c", 1), (2, 0, "xy", 2), (3, 0, "q", 1)], "doc_id long, ordinal long, piece string, length int")
    want = {1: "ab\0\0\0c", 2: "xz", 3: "qq", 4: ""}
    recorded = spark.createDataFrame([(k, len(v), hashlib.sha256(v.encode()).hexdigest()) for k, v in want.items()], "doc_id long, logical_len long, content_hash string")
    assert {r.doc_id: r.outcome for r in extents.restored(pieces, recorded).collect()} == {1: "ok", 2: "CONTENT_INTEGRITY_FAILED", 3: "EXTENT_INVALID", 4: "ok"}


ENTRIES = "path string, kind string, live_from long, live_to long"


def test_containment(spark):
    rows = [
        ("a", "directory", 0, 3), ("a", "directory", 3, 5), ("a", "file", 6, None),  # put again, deleted, then a file
        ("a/x", "file", 1, None), ("b", "file", 0, None), ("c/y", "file", 2, 4), ("a/d", "directory", 0, 5), ("a/d/z", "file", 0, 5),
    ]
    got = {(r.path, r.seq): r.fault for r in timeline.containment_faults(spark.createDataFrame(rows, ENTRIES), 8).collect()}
    want = {("a/x", 5): "MISSING_PARENT"} | {("a/x", k): "PARENT_NOT_DIRECTORY" for k in (6, 7, 8)} | {("c/y", k): "MISSING_PARENT" for k in (2, 3)}
    assert got == want
    left = spark.createDataFrame([("a/x",), ("a/b/c",), ("b",), ("ab/x",)], "path string")
    assert [tuple(r) for r in timeline.orphans(left, spark.createDataFrame([("a",), ("b",)], "path string")).collect()] == [("a", "a/b/c")]


def test_a_snapshot_costs_no_more_for_a_longer_history(spark):
    """Rows that meet wanted commits do not grow with the commits between them."""
    entries = spark.createDataFrame([(f"p{k}", k, 0, None) for k in range(20)], "path string, version long, live_from long, live_to long")
    wanted = spark.createDataFrame([(3,), (9_000,)], "seq long")
    assert timeline.in_snapshots(entries, 9_999, wanted).count() == 40
    plan = timeline.seen_by(entries, 9_999, wanted)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and timeline.seen_by(entries, 9_999, wanted).count() == 20
    assert timeline.counts(entries, 9_999).count() == 10_000


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.sampled_from(["put", "delete"]), st.sampled_from(["a", "b", "c"])), max_size=4), min_size=2, max_size=7), st.sets(st.integers(0, 6), min_size=1))
def test_a_rewrite_keeps_its_snapshots(spark, history, chosen):
    ops = spark.createDataFrame(ops_of(history), OPS)
    head = len(history) - 1
    kept = spark.createDataFrame([(k,) for k in sorted({k for k in chosen if k <= head} | {head})], "seq long")
    entries = timeline.intervals(ops)
    numbers = {r.seq: r.new_seq for r in retention.renumbered(kept).collect()}
    want = {(numbers[r.seq], r.path, r.version) for r in timeline.in_snapshots(entries, head, kept).collect()}
    rewritten = retention.rewritten(entries, kept, head).withColumnRenamed("new_seq", "seq")
    assert {(r.seq, r.path, r.version) for r in timeline.in_snapshots(timeline.intervals(rewritten), len(numbers) - 1).collect()} == want
    assert timeline.delete_faults(rewritten).count() == 0


def test_chunks_to_collect(spark):
    ids = lambda *x: spark.createDataFrame([(k,) for k in x], "chunk_id long")
    found = lambda *x: sorted(r.chunk_id for r in retention.collectable(*x).collect())
    assert found(ids(1, 2, 3, 4), ids(2, 9)) == [1, 3, 4]
    assert found(ids(1, 2, 3, 4), ids(2, 9), ids(2, 3, 3, 9, 7)) == [3]


def test_introductions_references_and_work(spark):
    introduced = spark.createDataFrame([(5, 0, "chunk", 1), (5, 1, "chunk", 1), (6, 0, "chunk", 2), (6, 0, "version", 2), (7, 0, "version", 9)], "seq long, place long, kind string, id long")
    held = spark.createDataFrame([("version", 9), ("chunk", 3)], "kind string, id long")
    assert {tuple(r) for r in audit.introduction_faults(introduced, held).collect()} == {(5, "chunk", 1), (7, "version", 9)}
    ops = spark.createDataFrame([(5, 0, "put", 1), (5, 1, "put", 2), (6, 0, "put", 2), (6, 1, "delete", None)], "seq long, op_seq long, op string, version long")
    told = spark.createDataFrame([(2, 6)], "version long, seq long")
    assert {tuple(r) for r in audit.delta_references(ops, told, spark.createDataFrame([(1,)], "version long")).collect()} == {(5, 1, 2)}
    items = spark.createDataFrame([(5, "chunk", 2, True), (5, "version", 0, False)], "seq long, kind string, dependencies long, located boolean")
    got = {r.seq: tuple(r)[1:] for r in audit.work_bound(ops, items, spark.createDataFrame([(5,), (5,), (5,)], "seq long")).collect()}
    assert got == {5: (2 * 1 + 2 + 2 + 3, 2 + 1 + (2 + 3) + 1 + 3, 10, 2), 6: (1, 2 + 1, 9, 2)}
    counted = spark.createDataFrame([(5, 2), (5, 1), (7, (1 << 63) - 1)], "seq long, n long")
    again = {r.seq: tuple(r)[1:] for r in audit.work_bound(ops, items, counted).collect()}
    assert again.pop(7) == ((1 << 63) - 1, (1 << 63) - 1, 0, 0) and again == got


def test_key_sets(spark):
    rows = lambda *x: spark.createDataFrame([(k, 0, op, i) for k, (op, i) in enumerate(x)], "seq long, op_seq long, op string, id string")
    assert audit.key_set_faults(rows(("add", "a"), ("add", "b"), ("remove", "a"))).count() == 0
    for ops, fault in ((("add", "a"), ("add", "a")), "already_there"), ((("add", "a"), ("remove", "b")), "not_there"), ((("add", "a"), ("remove", "a")), "none_left"):
        assert audit.key_set_faults(rows(*ops)).first().fault == fault
    assert audit.key_set_faults(rows(*[("add", str(k)) for k in range(17)])).first().fault == "too_many"
    assert [r.id for r in audit.key_set(rows(("add", "a"), ("add", "b"), ("remove", "a"))).collect()] == ["b"]


def test_levels_and_verdicts(spark):
    rows = spark.createDataFrame([("structural", "x", "RECORD_INVALID", 1, "a"), ("content", "y", "IO_ERROR", None, "b")], "level string, check string, code string, seq long, key string")
    got = [tuple(audit.verdict(rows.where(f"level = '{kind}'"), level).first())[1:] for kind, level in (("structural", "referential"), ("content", "stored"), ("content", "restoration"), ("none", "restoration"))]
    assert got == [(1, 0, 0, "FAIL", "FAIL"), (0, 0, 0, "PASS", "UNKNOWN"), (0, 0, 1, "UNKNOWN", "UNKNOWN"), (0, 0, 0, "PASS", "PASS")]


def test_health_rules(spark):
    """The matrix of evidence: none, current, other head, from the future, overdue, a failure at any age, lines that cannot be read."""
    schema = "event_id long, seq long, completed long, dimension string, kind string, status string"
    now, head, day = 10_000_000, 9, 86_400

    def status(*records, unreadable=0, limits=(("verify", 30 * day),)):
        rows = spark.createDataFrame([(k, s, c, "integrity", kind, st_) for k, (s, c, kind, st_) in enumerate(records)], schema)
        return {r.dimension: r.status for r in health.assessed(rows, now, head, dict(limits), unreadable).collect()}

    assert status()["integrity"] == "UNKNOWN"
    assert status((9, now, "verify", "PASS"))["integrity"] == "PASS"
    assert status((9, now - 30 * day, "verify", "PASS"))["integrity"] == "PASS"
    assert status((9, now - 30 * day - 1, "verify", "PASS"))["integrity"] == "OVERDUE"
    assert status((8, now, "verify", "PASS"))["integrity"] == "UNKNOWN"
    assert status((9, now + 1, "verify", "PASS"))["integrity"] == "UNKNOWN"
    assert status((3, 0, "verify", "FAIL"))["integrity"] == "FAIL"
    assert status((9, 1, "verify", "FAIL"), (9, now, "verify", "PASS"))["integrity"] == "PASS"
    assert status((9, now, "verify", "PASS"), (9, now + 5, "verify", "UNKNOWN"))["integrity"] == "PASS"
    assert status((9, now, "verify", "PASS"), unreadable=1)["integrity"] == "UNKNOWN"
    assert status((9, now, "restore_test", "PASS"))["integrity"] == "UNKNOWN"
    rest = status()
    assert (rest["searchability"], rest["retention_compliance"], rest["durability"], rest["freshness"]) == ("UNSUPPORTED", "UNSUPPORTED", "UNKNOWN", "UNKNOWN")


def test_recovery_from_manifests(spark):
    schema = "archive string, kind string, seq long, hash string, parent_hash string, parent_seq long"
    chain = [("a", "delta", k, f"h{k}", f"h{k - 1}" if k else None, k - 1 if k else None) for k in range(5)]
    frame = lambda rows: spark.createDataFrame(rows, schema)
    got = recovery.manifest_chain(frame([*chain, ("a", "delta", 3, "other", "h2", 2), ("a", "snapshot", 2, "s", None, None)]), "h4")
    assert sorted((r.seq, r.hash) for r in got.collect()) == [(k, f"h{k}") for k in range(5)]
    broken = recovery.manifest_chain(frame([*chain[:2], *chain[3:]]), "h4")
    assert sorted((r.seq, r.broken) for r in broken.collect()) == [(3, True), (4, False)]
    none = spark.createDataFrame([], "seq long")
    assert tuple(recovery.recovered_range(got, none).first()) == (0, 4, 0, None)
    assert tuple(recovery.recovered_range(got, spark.createDataFrame([(3,)], "seq long")).first()) == (0, 2, 0, None)
    assert tuple(recovery.recovered_range(broken, none).first()) == (None, None, 3, 3)
    choose = lambda rows: tuple(recovery.head_choice(frame(rows)).first())
    assert choose(chain) == ("h4", None) and choose([*chain, ("b", "delta", 0, "x", None, None)])[1] == "several_archives"
    assert choose([*chain, ("a", "delta", 4, "y", "h3", 3)])[1] == "several_heads" and choose([("a", "snapshot", 2, "s", None, None)])[1] == "no_delta" and choose([])[1] == "no_manifests"


def test_restore_selection_and_preflight(spark):
    frame = lambda *x: spark.createDataFrame([(p,) for p in x], "path string")
    entries = frame("a", "a/b", "a/b/c", "a/d", "ab", "x")
    assert sorted(r.path for r in recovery.selected(entries, frame("a/b")).collect()) == ["a", "a/b", "a/b/c"]
    assert recovery.selected(entries, frame()).count() == 6
    got = {r.path: r.exception for r in recovery.preflight(frame("d/A", "d/a", "d/a/x", "d/nul", "d/NUL.", "d/ok")).collect()}
    assert got == {"d/a": "collision", "d/a/x": "parent_not_restored", "d/nul": "name: reserved_name", "d/NUL.": "name: trailing_dot_or_space"}


def test_times_and_fields(spark):
    frame = spark.createDataFrame([(x,) for x in ("2024-02-29T23:59:60.000000001Z", "2023-02-29T00:00:00.000000000Z", "2024-01-01T24:00:00.000000000Z", "2024-01-01T00:00:00.5Z", "1970-01-01T00:00:01.999999999Z")], "t string")
    got = [r.x for r in frame.select(text.time_of("t").alias("x")).collect()]
    assert got[0].leap and got[0].secs == 1709251199 and got[0].nanos == 1 and got[1:4] == [None] * 3 and (got[4].secs, got[4].nanos) == (1, 999999999)
    frame = spark.createDataFrame([(0, 0), (-1, 999_999_999), (1, 1_000_000_000), (1 << 60, 0)], "s long, n long")
    assert [r[0] for r in frame.select(text.written_time("s", "n")).collect()] == ["1970-01-01T00:00:00.000000000Z", "1969-12-31T23:59:59.999999999Z", None, None]
    frame = spark.createDataFrame([("0000644\0",), ("  17 ",), ("8",), ("",)], "f string")
    assert [r[0] for r in frame.select(text.octal("f")).collect()] == [420, 15, None, None]
    frame = spark.createDataFrame([("a\\b\n\u202e\x07",)], "n string")
    assert frame.select(text.shown("n")).first()[0] == "a\\\\b\\n\\u{202e}\\u{7}"


def test_path_rules(spark):
    names = ["", "a//b", "a/../b", "a/" + "x" * 1025, "/".join("a" * 1025), "a/b"]
    frame = spark.createDataFrame([(n,) for n in names], "p string")
    assert [r[0] for r in frame.select(paths.fault("p")).collect()] == ["empty", "empty_component", "dot_component", "component_too_long", "too_deep", None]
    frame = spark.createDataFrame([(n,) for n in ("docs", "docs/a", "docsx", "x/docs")], "p string")
    assert [r[0] for r in frame.select(paths.within("p", "docs")).collect()] == [True, True, False, False]
    frame = spark.createDataFrame([("ÉA",)], "p string")
    assert frame.select(paths.folded("p")).first()[0] == "Éa"
    frame = spark.createDataFrame([(n,) for n in ("a:b", "a.", "NUL.txt", "com1", "fine", "NUL .txt", "COM²", "lpt¹.log", "com0", "a\ufffdb", "console")], "p string")
    want = ["illegal_character", "trailing_dot_or_space", "reserved_name", "reserved_name", None, "reserved_name", "reserved_name", "reserved_name", None, "not_representable", None]
    assert [r[0] for r in frame.select(paths.windows_issue("p")).collect()] == want
    frame = spark.createDataFrame([(n,) for n in ("docs", "docs/a", "docs0", "docs/", "doc")], "p string")
    low, high = paths.descendant_bounds("docs")
    assert [r[0] for r in frame.where((F.col("p") > low) & (F.col("p") < high)).collect()] == ["docs/a"] == [r[0] for r in frame.where(paths.below("p", "docs")).collect()]
    assert frame.where(paths.has("p", "")).count() == 5 and frame.where(paths.has("p", "CS/", fold=True)).count() == 2


def test_retention_faults_and_roots(spark):
    ops = [(1, "label", "a", "hold"), (2, "label", "a", "hold"), (3, "label", "b", "release"), (4, "label", "a", "release"), (5, "snapshot", "3", "expire"), (6, "snapshot", "3", "expire")]
    got = {r.op_id: r.fault for r in retention.replay(spark.createDataFrame(ops, "op_id long, family string, key string, kind string")).collect()}
    assert got == {1: None, 2: "duplicate_hold", 3: "inactive_label", 4: None, 5: None, 6: "expired_twice"}
    seqs = spark.range(5).withColumnRenamed("id", "seq")
    kept = retention.roots(seqs, seqs.where("seq <> 2"), seqs.where("seq = 1"), 4)
    assert sorted(r.seq for r in kept.collect()) == [1, 2, 4]


def test_statuses(spark):
    frame = spark.createDataFrame([("a", "PASS"), ("a", "OVERDUE"), ("b", "FAIL"), ("b", "PASS")], "g string, s string")
    assert {r.g: r.w for r in frame.groupBy("g").agg(health.worst("s").alias("w")).collect()} == {"a": "OVERDUE", "b": "FAIL"}
    assert frame.where("false").agg(health.worst("s").alias("w")).first().w == "UNKNOWN"
    cases = [("FAIL", True, 1), ("PASS", True, 3), ("UNSUPPORTED", False, 4), ("DEGRADED", False, 2), ("PASS", False, 0)]
    frame = spark.createDataFrame(cases, "w string, e boolean, code long")
    assert frame.where(health.exit_code("w", "e") != F.col("code")).count() == 0


def test_evidence_is_judged_in_order(spark):
    records = [(k, 9 if k != 2 else 8, 100 if k != 3 else 500, d, "verify", s) for k, d, s in ((1, "a", "FAIL"), (2, "b", "PASS"), (3, "c", "PASS"), (4, "d", "PASS"))]
    records.append((5, 9, 190, "e", "verify", "DEGRADED"))
    rows = spark.createDataFrame(records, "event_id long, seq long, completed long, dimension string, kind string, status string")
    got = {r.dimension: r.judgement for r in health.judged(health.latest(rows), rows.where("status = 'FAIL'"), now=200, head=9, limit=50).collect()}
    assert got == {"a": "FAIL", "b": "UNKNOWN", "c": "UNKNOWN", "d": "OVERDUE", "e": "DEGRADED"}


def test_schedule_fires_at_the_ratio(spark):
    rows = spark.createDataFrame([(0, k, 10) for k in range(6)] + [(1, k, s) for k, s in enumerate((100, 40, 60, 1))], "archive long, seq long, bytes long")
    got = {(r.archive, r.seq) for r in segments.schedule(rows, floor=20).where("fires").collect()}
    assert got == {(0, 0), (0, 3), (1, 0), (1, 3)}


def test_repair_and_collisions(spark):
    entries = spark.createDataFrame([("a", 1), ("a/b", 2), ("a/b/c", 3), ("ab", 4), ("d", 5)], "path string, version long")
    got = {r.path: r.reason for r in recovery.repaired(entries, entries.where("version = 1")).collect()}
    assert got == {"a": "bad_version", "a/b": "below_dropped", "a/b/c": "below_dropped"}
    names = spark.createDataFrame([("x/A",), ("x/a",), ("y/a",)], "path string")
    assert [tuple(r) for r in recovery.collisions(names).collect()] == [("x/a", "x/A")]
