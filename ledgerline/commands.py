"""What a user asks of an archive, composed from the operators: one function for each command.

An archive is a `Relations`: its tables as DataFrames, lazily read. Every command returns DataFrames (or a
dataclass of them) and runs nothing but what an answer needs beforehand, such as the number of the head.
Wall-clock time is always a parameter.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.operators import audit, health, recovery, retention, search, segments, timeline
from ledgerline.operators import extents as extent_ops

#: Commands that exist by name only; they answer so, with the exit code of what is not supported.
STUBS = ("inventory", "split", "join", "mount")


@dataclass
class Relations:
    """commits (seq, parent_seq), ops (seq, op_seq, op, path, version), versions (version, kind, logical_len,
    content_hash), extents (version, ordinal, logical_offset, length, chunk_id, chunk_offset), chunks (chunk_id,
    decoded_len, bytes), retention (op_id, seq, kind, target, label), dependencies (chunk_id, dependency_id)."""

    commits: DataFrame
    ops: DataFrame
    versions: DataFrame
    extents: DataFrame
    chunks: DataFrame
    retention: DataFrame
    dependencies: DataFrame

    def head(self) -> int:
        found = self.commits.agg(F.max("seq")).first()[0]
        if found is None:
            raise ValueError("nothing has been committed")
        return found

    def at(self, seq: int | None) -> int | None:
        """A commit that exists, or the head."""
        if seq is not None and self.commits.where(F.col("seq") == seq).isEmpty():
            raise ValueError(f"there is no commit {seq}")
        return seq

    def entries(self) -> DataFrame:
        """path, version, kind, live_from, live_to."""
        return timeline.intervals(self.ops).join(self.versions.select("version", "kind"), "version", "left")

    def kept_ops(self) -> DataFrame:
        family = F.when(F.col("kind") == "expire", "snapshot").otherwise("label")
        return self.retention.withColumns({"family": family, "key": F.coalesce("label", F.col("target").cast("string"))})

    def roots(self) -> DataFrame:
        ops = self.kept_ops()
        expired = ops.where("kind = 'expire'").select(F.col("target").alias("seq")).distinct()
        return retention.roots(self.commits.select("seq"), expired, retention.holds(ops.withColumn("seq", F.col("target"))), self.head())


def unsupported(name: str) -> DataFrame:
    raise NotImplementedError(f"{name} is not supported (exit code 4)")


def listed(archive: Relations, under: str | None = None, seq: int | None = None) -> DataFrame:
    """`list`: path, kind, logical_len, content_hash, by path."""
    return search.listing(timeline.snapshot(archive.ops, archive.at(seq)), archive.versions, under)


def found(archive: Relations, query: search.Query, scope: str | list[int] = "head") -> tuple[DataFrame, DataFrame]:
    """`search`: hits by commit and path, and coverage. The scope is head, all, retained, or commits by number."""
    head = archive.head()
    seqs = archive.commits.select("seq")
    wanted = {"head": lambda: seqs.where(F.col("seq") == head), "all": lambda: seqs, "retained": archive.roots}
    asked = wanted[scope]() if isinstance(scope, str) else seqs.sparkSession.createDataFrame([(s,) for s in scope], "seq long")
    joined = archive.entries().join(archive.versions.drop("kind"), "version")
    return search.over_snapshots(joined, head, asked, seqs, query.of_entry() & query.of_version())


def snapshots(archive: Relations) -> DataFrame:
    """`snapshot list`: seq, retained and the labels that hold it."""
    holds = retention.holds(archive.kept_ops().withColumn("seq", F.col("target"))).groupBy("seq").agg(F.sort_array(F.collect_list("label")).alias("holds"))
    rows = archive.commits.select("seq").join(archive.roots().withColumn("retained", F.lit(True)), "seq", "left").join(holds, "seq", "left")
    return rows.select("seq", F.coalesce("retained", F.lit(False)).alias("retained"), F.coalesce("holds", F.array().cast("array<string>")).alias("holds")).orderBy("seq")


def restore_plan(archive: Relations, selection: list[str], seq: int | None = None) -> DataFrame:
    """`get`: path, kind, slices, exception of the selected entries, in the order in which they are made: parents
    first. A path that is not there is refused before anything."""
    entries = timeline.snapshot(archive.ops, archive.at(seq)).join(archive.versions.select("version", "kind"), "version")
    chosen = entries.sparkSession.createDataFrame([(p,) for p in selection], "path string")
    missing = chosen.join(entries, "path", "left_anti").first()
    if missing:
        raise ValueError(f"there is no entry {missing.path}")
    rows = recovery.selected(entries.select("path", "version", "kind"), chosen)
    plan = rows.join(extent_ops.read_slices(archive.extents), "version", "left").join(recovery.preflight(rows.select("path")), "path", "left")
    return plan.select("path", "kind", "slices", "exception").orderBy(F.split("path", "/"))


def verified(archive: Relations, level: str = "referential") -> tuple[DataFrame, DataFrame]:
    """`verify` and `fsck`: the findings up to a level, and what they conclude."""
    checks = audit.catalog(archive.ops, archive.commits, archive.entries(), archive.versions, archive.extents, "ordinal", archive.chunks, archive.head())
    return audit.upto(checks, level), audit.verdict(checks, level)


def judged(evidence: DataFrame, now: int, head: int, limits: dict[str, int], required: list[str], unreadable: int = 0, fresh: str | None = None) -> DataFrame:
    """`health`: one row: dimensions, overall_status, policy_result, exit_code."""
    rows = health.assessed(evidence, now, head, limits, unreadable, fresh)
    whole = rows.agg(F.map_from_entries(F.collect_list(F.struct("dimension", "status"))).alias("dimensions"))
    told = whole.withColumns({"required": F.array(*map(F.lit, required)).cast("array<string>"), "operational": F.lit(False)})
    if fresh is not None:
        told = told.withColumn("required", F.array_union("required", F.array(F.lit("freshness"))))
    return health.concluded(told)


def checkpoints(commits: DataFrame, floor: int, numerator: int = 1, denominator: int = 1) -> DataFrame:
    """`checkpoint`: archive, seq, fires of commits (archive, seq, bytes, forced)."""
    return segments.schedule(commits, floor, numerator, denominator)


def collection(archive: Relations, streams: bool = False) -> retention.Plan:
    """`gc plan`: refused where a marked chunk depends on others."""
    plan = retention.plan(archive.entries().select("path", "version", "live_from", "live_to"), archive.commits.select("seq"), archive.kept_ops(), archive.versions, archive.chunks, archive.extents, archive.dependencies, archive.head(), streams)
    refused = plan.refused.first()
    if refused:
        raise NotImplementedError(f"chunk {refused.chunk_id} has dependencies (exit code 4)")
    return plan


@dataclass
class Rewrite:
    """A smaller archive with the same kept snapshots."""

    numbers: DataFrame  # seq, new_seq
    ops: DataFrame  # new_seq, op_seq, op, path, version
    versions: DataFrame
    extents: DataFrame
    chunks: DataFrame
    retention: DataFrame  # kind, label, seq, new_seq
    collected: DataFrame  # seq below the head that is not kept


def compacted(archive: Relations, everything: bool = False) -> Rewrite:
    """`compact` and `gc apply`: one commit for each kept snapshot, with what these need. `everything` keeps all."""
    head, entries = archive.head(), archive.entries().select("path", "version", "live_from", "live_to")
    seqs = archive.commits.select("seq")
    kept = seqs if everything else archive.roots()
    numbers = retention.renumbered(kept)
    versions, chunks = retention.mark(entries, kept, archive.extents, head)
    state = archive.kept_ops()
    held = retention.holds(state.withColumn("seq", F.col("target"))).select(F.lit("hold").alias("kind"), "label", "seq")
    expired = state.where("kind = 'expire'").select(F.lit("expire").alias("kind"), F.lit(None).cast("string").alias("label"), F.col("target").alias("seq")).distinct()
    return Rewrite(
        numbers=numbers,
        ops=retention.rewritten(entries, kept, head),
        versions=archive.versions.join(versions, "version", "left_semi"),
        extents=archive.extents.join(versions, "version", "left_semi"),
        chunks=archive.chunks.join(chunks, "chunk_id", "left_semi"),
        retention=retention.carried(held.unionByName(expired), numbers),
        collected=seqs.join(kept, "seq", "left_anti").where(F.col("seq") < head),
    )


def rewrite_differences(archive: Relations, rewrite: Rewrite) -> DataFrame:
    """seq, n: kept snapshots that a rewrite does not give back; none, if it is right."""
    head = archive.head()
    entries = archive.entries().select("path", "version", "live_from", "live_to")
    ours = timeline.in_snapshots(entries, head, rewrite.numbers.select("seq")).join(rewrite.numbers, "seq").select(F.col("new_seq").alias("seq"), "path", "version")
    ops = rewrite.ops.withColumnRenamed("new_seq", "seq")
    last = rewrite.numbers.agg(F.max("new_seq")).first()[0]
    return timeline.differing_snapshots(ours, timeline.in_snapshots(timeline.intervals(ops), last).select("seq", "path", "version"))


@dataclass
class Repair:
    """What of a damaged archive can be kept, and why not the rest."""

    supplied: DataFrame  # seq, catalog_seq
    lost: DataFrame  # seq, reason
    bad: DataFrame  # version, reason
    omitted: DataFrame  # path, version, reason, snapshots
    outcome: DataFrame  # outcome, exit_code


def repair_plan(archive: Relations, catalogs: DataFrame, errors: DataFrame, promised: DataFrame, failed: DataFrame, first_trusted: int | None = None) -> Repair:
    """`repair plan`: from which catalogs open and what they hold (catalog_seq, seq, opens), errors of opening
    commits (seq, code), promised attributes (version, attributes) and versions whose content fails."""
    head = archive.head()
    supplied = recovery.suppliers(catalogs)
    lost = recovery.lost_snapshots(archive.commits, supplied, errors, first_trusted)
    rows = timeline.in_snapshots(archive.entries(), head, supplied.select("seq"))
    bad = recovery.bad_versions(rows.select("version", "kind").distinct(), promised, failed)
    left = recovery.omitted(rows.select("seq", "path", "version"), bad)
    return Repair(supplied, lost, bad, left, recovery.outcome(supplied, lost, left))


def repaired(archive: Relations, repair: Repair) -> DataFrame:
    """`repair apply`: new_seq, path, version of every snapshot that is kept, without what is left out."""
    numbers = retention.renumbered(repair.supplied.select("seq"))
    rows = timeline.in_snapshots(archive.entries(), archive.head(), repair.supplied.select("seq")).select("seq", "path", "version")
    gone = repair.omitted.select("path", "version", F.explode("snapshots").alias("seq"))
    return rows.join(gone, ["seq", "path", "version"], "left_anti").join(numbers, "seq").select("new_seq", "path", "version")


def state_differences(left: Relations, right: Relations) -> DataFrame:
    """component, key, difference of two archives that should be in the same state: namespace, versions, chunks
    and holds at their heads, in that order and by key."""
    holds = lambda a: retention.holds(a.kept_ops().withColumn("seq", F.col("target"))).select(F.col("label").alias("path"), F.col("seq").alias("version"))
    parts = {
        "namespace": lambda a: timeline.snapshot(a.ops),
        "versions": lambda a: a.versions.select(F.col("version").cast("string").alias("path"), F.xxhash64("kind", "logical_len", "content_hash").alias("version")),
        "chunks": lambda a: a.chunks.select(F.col("chunk_id").cast("string").alias("path"), F.xxhash64("decoded_len", "bytes").alias("version")),
        "holds": holds,
    }
    out = [timeline.state_differences(timeline.joined(f(left), f(right))).select(F.lit(k).alias("place"), F.lit(name).alias("component"), F.col("path").alias("key"), "difference") for k, (name, f) in enumerate(parts.items())]
    return audit.findings(out).orderBy("place", "key").drop("place")


def dumped(tables: dict[str, DataFrame], only: list[str] | None = None) -> tuple[DataFrame, dict[str, DataFrame]]:
    """`dump-index`: table_name, row_count of the relations, and their rows in order."""
    chosen = {n: tables[n] for n in sorted(only or tables)}
    counts = [t.agg(F.lit(n).alias("table_name"), F.count("*").alias("row_count")) for n, t in chosen.items()]
    return audit.findings(counts), {n: search.dump(t) for n, t in chosen.items()}
