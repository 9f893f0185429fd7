"""Archives as folders of Parquet: commits are appended, checked as a whole, and seen only once marked.

    ops/commit_seq=N        the operations of commit N
    retention/commit_seq=N  its retention operations
    marks/N                 an empty file, made last; a commit without one does not exist
    checkpoints/N           the state at commit N, for readers that should not replay from the start
    manifests/N             that state with versions, extents and chunks, from which an archive can be rebuilt

A mark is created without overwriting, so of two writers of one number one fails. What a failed writer has
left is never read, and is overwritten by the next.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import retention, timeline

OPS = "op_seq long, op string, path string, target string, version long, kind string"
RETENTION = "op_id long, kind string, target long, label string"


class Refused(ValueError):
    """A commit that would not leave a valid archive; nothing of it is visible."""


@dataclass
class Transaction:
    """Operations of one commit, in the order of the calls."""

    ops: list[tuple] = field(default_factory=list)
    kept: list[tuple] = field(default_factory=list)

    def _op(self, op: str, path: str, target: str | None = None, version: int | None = None, kind: str | None = None) -> Transaction:
        self.ops.append((len(self.ops), op, path, target, version, kind))
        return self

    def put_file(self, path: str, version: int) -> Transaction:
        return self._op("put", path, version=version, kind="file")

    def put_dir(self, path: str, version: int) -> Transaction:
        return self._op("put", path, version=version, kind="directory")

    def delete(self, path: str) -> Transaction:
        return self._op("delete", path)

    def rename(self, path: str, target: str) -> Transaction:
        return self._op("rename", path, target)

    def _keep(self, kind: str, seq: int | None, label: str | None) -> Transaction:
        self.kept.append((len(self.kept), kind, seq, label))
        return self

    def expire(self, seq: int) -> Transaction:
        return self._keep("expire", seq, None)

    def hold(self, label: str, seq: int) -> Transaction:
        return self._keep("hold", seq, label)

    def release(self, label: str) -> Transaction:
        return self._keep("release", None, label)


class Archive:
    """An archive in a folder that Spark reads and writes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: object):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *map(str, parts)]))
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _marked(self, what: str) -> list[int]:
        path, fs = self._path(what)
        return sorted(int(s.getPath().getName()) for s in fs.listStatus(path)) if fs.exists(path) else []

    def head(self) -> int | None:
        """The number of the newest commit; None in an empty archive."""
        return max(self._marked("marks"), default=None)

    def _table(self, name: str, schema: str) -> DataFrame:
        path, fs = self._path(name)
        head = self.head()
        if head is None or not fs.exists(path):
            return self.spark.createDataFrame([], f"{schema}, commit_seq long")
        # Numbers are contiguous, so what is marked is what does not exceed the head; the filter prunes folders.
        return self.spark.read.schema(f"{schema}, commit_seq long").parquet(f"{self.folder}/{name}").where(F.col("commit_seq") <= head)

    def ops(self) -> DataFrame:
        """seq, op_seq, op, path, version, kind of every operation."""
        return self._table("ops", OPS).select(F.col("commit_seq").alias("seq"), "op_seq", "op", "path", "version", "kind")

    def retention_ops(self) -> DataFrame:
        rows = self._table("retention", RETENTION).withColumnRenamed("commit_seq", "seq")
        return rows.withColumns({"op_id": F.struct("seq", "op_id"), "family": F.when(F.col("kind") == "expire", "snapshot").otherwise("label"), "key": F.coalesce("label", F.col("target").cast("string"))})

    def kinds(self, ops: DataFrame) -> DataFrame:
        """path, version, kind, live_from, live_to of the entries of a log."""
        kinds = ops.where("op = 'put'").groupBy("version").agg(F.any_value("kind").alias("kind"))
        return timeline.intervals(ops).join(kinds, "version", "left")

    def snapshot(self, seq: int | None = None) -> DataFrame:
        """path, version at a commit or at the head: from the newest checkpoint up to it and what came after."""
        head = self.head()
        if seq is not None and (head is None or seq < 0 or seq > head):
            raise ValueError(f"there is no commit {seq}")
        at = head if seq is None else seq
        base = max((c for c in self._marked("checkpoints") if at is not None and c <= at), default=None)
        if base is None:
            return timeline.snapshot(self.ops(), seq)
        after = self.ops().where((F.col("seq") > base) & (F.col("seq") <= at)).select("seq", "op_seq", "op", "path", "version")
        start = self.spark.read.schema("path string, version long").parquet(f"{self.folder}/checkpoints/{base}")
        rows = start.select(F.lit(base).cast("long").alias("seq"), F.lit(-1).cast("long").alias("op_seq"), F.lit("put").alias("op"), "path", "version")
        return timeline.snapshot(rows.unionByName(after))

    def faults(self, staged: DataFrame, seq: int) -> DataFrame:
        """fault, path: what the staged operations would break, judged with the whole log before them."""
        log = self.ops().unionByName(staged)
        deletes = timeline.delete_faults(log).where(F.col("seq") == seq).select(F.lit("DELETE_MISSING").alias("fault"), "path")
        unknown = staged.where("op = 'put' and version is null").select(F.lit("UNKNOWN_VERSION").alias("fault"), "path")
        lying = timeline.containment_faults(self.kinds(log), seq).where(F.col("seq") == seq).select("fault", "path")
        return unknown.unionByName(deletes).unionByName(lying)

    def commit(self, transaction: Transaction) -> int:
        """Append a transaction; the number of the commit. Raises Refused, and changes nothing, if it does not hold."""
        head = self.head()
        seq = 0 if head is None else head + 1
        ops = self.spark.createDataFrame(transaction.ops, OPS).withColumn("seq", F.lit(seq).cast("long"))
        before = self.snapshot().join(self.ops().where("op = 'put'").groupBy("version").agg(F.any_value("kind").alias("held_kind")), "version", "left")
        staged = timeline.expanded(ops.drop("kind", "target").join(ops.select("op_seq", "target"), "op_seq"), before)
        told = ops.where("op = 'put'").select(F.col("version"), "kind").unionByName(before.select("version", F.col("held_kind").alias("kind")))
        staged = staged.join(told.groupBy("version").agg(F.any_value("kind").alias("kind")), "version", "left").select("seq", "op_seq", "op", "path", "version", "kind")
        found = self.faults(staged, seq).orderBy("fault", "path").first()
        if found:
            raise Refused(f"{found.fault}: {found.path}")
        kept = self.spark.createDataFrame(transaction.kept, RETENTION)
        own = kept.withColumns({"seq": F.lit(seq).cast("long"), "family": F.when(F.col("kind") == "expire", "snapshot").otherwise("label"), "key": F.coalesce("label", F.col("target").cast("string"))}).withColumn("op_id", F.struct("seq", "op_id"))
        wrong = retention.operation_faults(own).first() or retention.replay(self.retention_ops().unionByName(own.select(self.retention_ops().columns))).where(F.col("fault").isNotNull() & (F.col("seq") == seq)).first()
        if wrong:
            raise Refused(wrong.fault)
        staged.drop("seq").withColumn("target", F.lit(None).cast("string")).write.mode("overwrite").parquet(f"{self.folder}/ops/commit_seq={seq}")
        kept.write.mode("overwrite").parquet(f"{self.folder}/retention/commit_seq={seq}")
        path, fs = self._path("marks", seq)
        fs.create(path, False).close()
        return seq

    def checkpoint(self, seq: int | None = None) -> int:
        """Write the state at a commit as one that replays can begin from."""
        at = self.head() if seq is None else seq
        self.snapshot(at).write.mode("overwrite").parquet(f"{self.folder}/.checkpoints-{at}")
        source, fs = self._path(f".checkpoints-{at}")
        target, _ = self._path("checkpoints", at)
        fs.mkdirs(target.getParent())
        fs.delete(target, True)
        fs.rename(source, target)
        return at

    def manifest(self, versions: DataFrame, extents: DataFrame, chunks: DataFrame, seq: int | None = None) -> str:
        """Write everything that the snapshot at a commit needs, and nothing else; the folder. What is missing
        from the relations raises Refused."""
        at = self.head() if seq is None else seq
        entries = self.snapshot(at)
        lost = timeline.closure_faults(entries, versions, extents, chunks).first()
        if lost:
            raise Refused(f"the {lost.missing} {lost.key} is missing")
        named, used = timeline.reachable(entries, extents)
        folder = f"{self.folder}/manifests/{at}"
        tables = {"entries": entries, "file_versions": versions.join(named, "version", "left_semi"), "file_extents": extents.join(named, "version", "left_semi"), "chunks": chunks.join(used, "chunk_id", "left_semi")}
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{folder}/{name}")
        return folder


def catalog_of(spark: SparkSession, folder: str, seq: int) -> dict[str, DataFrame]:
    """The relations of a catalog rebuilt from a snapshot manifest: one commit without a parent, which puts all
    entries by path. Earlier snapshots are not in it."""
    read = lambda name: spark.read.parquet(f"{folder}/{name}")
    ops = read("entries").select(F.lit(seq).cast("long").alias("seq"), F.struct("path").alias("op_seq"), F.lit("put").alias("op"), "path", "version")
    commits = spark.createDataFrame([(seq, None)], "seq long, parent_seq long")
    return {"commits": commits, "namespace_ops": ops} | {n: read(n) for n in ("file_versions", "file_extents", "chunks")}
