"""The streamed head equals the snapshot at the last commit."""

from ledgerline.operators import timeline
from ledgerline.streaming import tail


def test_streamed_head_equals_snapshot(spark, tmp_path):
    history = [(0, 0, "put", "a", 1), (0, 1, "put", "b", 2), (1, 0, "delete", "a", None), (1, 1, "put", "c", 3), (2, 0, "put", "b", 4)]
    ops = spark.createDataFrame(history, tail.OPS)
    for seq in (2, 0, 1):  # files out of order
        ops.where(f"seq = {seq}").coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
    query = tail.follow(tail.ops_stream(spark, str(tmp_path / "ops"), 1), str(tmp_path / "head"), str(tmp_path / "state"))
    query.awaitTermination(60)
    got = {(r.path, r.version) for r in tail.head(spark, str(tmp_path / "head")).collect()}
    assert got == {(r.path, r.version) for r in timeline.snapshot(ops, 2).collect()} == {("b", 4), ("c", 3)}
