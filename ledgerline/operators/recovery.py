"""Damage scope, recovery from manifests, repair and restore planning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import paths

from .segments import with_base


def damage(commits: DataFrame, *archive: str) -> DataFrame:
    """seq, base_seq, blocker: what keeps a commit from being opened; its own record first, then the
    first broken delta since its segment's base."""
    rows = with_base(commits, *archive)
    segment = Window.partitionBy(*archive, "base_seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    first = F.min(F.when(~F.col("intact"), F.col("seq"))).over(segment)
    blocker = F.when(~F.col("intact"), "own_record").when(first.isNotNull(), F.concat(F.lit("delta "), first.cast("string")))
    return rows.select(*archive, "seq", "base_seq", blocker.alias("blocker"))


def damage_scope(commits: DataFrame, *archive: str) -> DataFrame:
    """seq, base_seq, blocker, readable, status of commits (seq, is_checkpoint and, each ok or not, descriptor,
    delta, image, snapshot; `stored` where a failure is damage to stored bytes).

    What opening meets first blocks it: the commit's own descriptor; its own delta (of a checkpoint, only
    failures that are not damage); the segment's descriptor; the first delta since the base. Without a
    blocker the base's image serves, or, if that is damaged, its snapshot manifest.
    """
    rows = with_base(commits, *archive)
    base = rows.where("is_checkpoint").select(*archive, F.col("seq").alias("base_seq"), *[F.col(c).alias(f"base_{c}") for c in ("descriptor", "image", "snapshot", "stored")])
    rows = rows.join(base, [*archive, "base_seq"], "left")
    segment = Window.partitionBy(*archive, "base_seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    first_delta = F.min(F.when(~F.col("delta") & ~F.col("is_checkpoint"), F.col("seq"))).over(segment)
    rows = rows.withColumn("_first", first_delta)
    blocker = (
        F.when(~F.col("descriptor"), "own_descriptor")
        .when(~F.col("delta") & (~F.col("is_checkpoint") | ~F.col("stored")), "own_delta")
        .when(~F.coalesce("base_descriptor", F.lit(False)), "segment_descriptor")
        .when(F.col("_first").isNotNull(), F.concat(F.lit("delta "), F.col("_first").cast("string")))
    )
    rows = rows.withColumn("blocker", blocker)
    readable = (
        F.when(F.col("blocker").isNotNull(), "unreadable")
        .when(F.col("base_image"), "image")
        .when(F.col("base_stored") & F.col("base_snapshot"), "snapshot")
        .otherwise("unreadable")
    )
    rows = rows.withColumn("readable", readable)
    status = F.when(F.col("readable") == "unreadable", "FAIL").when((F.col("readable") == "snapshot") | ~F.col("base_snapshot"), "DEGRADED").otherwise("PASS")
    return rows.select(*archive, "seq", "base_seq", "blocker", "readable", status.alias("status"))


def damage_ranges(commits: DataFrame, *archive: str) -> DataFrame:
    """role, first, last, effect of every damaged object (commits as in `damage_scope`): how far its damage reaches."""
    rows = with_base(commits, *archive)
    whole = Window.partitionBy(*archive, "base_seq")
    rows = rows.withColumn("end", F.max("seq").over(whole))
    point = F.col("is_checkpoint")
    found = [
        F.when(~F.col("descriptor"), F.struct(F.lit("descriptor").alias("role"), F.when(point, F.col("end")).otherwise(F.col("seq")).alias("last"), F.lit("unreadable").alias("effect"))),
        F.when(~F.col("delta"), F.struct(F.lit("delta").alias("role"), F.when(point, F.col("seq")).otherwise(F.col("end")).alias("last"), F.when(point & F.col("stored"), "no_read_affected").otherwise("unreadable").alias("effect"))),
        F.when(point & ~F.col("image"), F.struct(F.lit("image").alias("role"), F.col("end").alias("last"), F.when(F.col("stored") & F.col("snapshot"), "reads_from_snapshot").otherwise("unreadable").alias("effect"))),
        F.when(point & ~F.col("snapshot"), F.struct(F.lit("snapshot").alias("role"), F.col("end").alias("last"), F.when(F.col("image"), "degraded").otherwise("unreadable").alias("effect"))),
    ]
    out = rows.withColumn("x", F.explode(F.array_compact(F.array(*found))))
    return out.select(*archive, "x.role", F.col("seq").alias("first"), "x.last", "x.effect")


def repaired(entries: DataFrame, bad_versions: DataFrame) -> DataFrame:
    """path, reason of what a repair leaves out: entries of bad versions, and all below a dropped one.

    Ancestors are unrolled and joined by equality; depth is bounded, the tree is not.
    """
    bad = entries.join(bad_versions.select("version").withColumn("bad", F.lit(True)), "version", "left").withColumn("bad", F.coalesce("bad", F.lit(False)))
    dropped = bad.where("bad").select(F.col("path").alias("ancestor"))
    below = bad.withColumn("ancestor", F.explode(paths.ancestors("path"))).where("ancestor <> path").join(dropped, "ancestor", "left_semi").select("path").distinct()
    rows = bad.join(below.withColumn("orphaned", F.lit(True)), "path", "left")
    reason = F.when(F.col("bad"), "bad_version").when(F.col("orphaned"), "below_dropped")
    return rows.select("path", reason.alias("reason")).where("reason is not null")


def omitted(entries: DataFrame, bad: DataFrame) -> DataFrame:
    """path, version, reason, snapshots: what a repair leaves out of the snapshots (seq, path, version), one row
    for each path and version with its reason in the first of them. `bad` has version and reason."""
    rows = entries.join(bad, "version", "left").withColumnRenamed("reason", "own")
    dropped = rows.where("own is not null").select("seq", F.col("path").alias("ancestor"))
    below = rows.select("seq", "path", F.explode(paths.ancestors("path")).alias("ancestor")).where("ancestor <> path").join(dropped, ["seq", "ancestor"], "left_semi")
    rows = rows.join(below.select("seq", "path").distinct().withColumn("_below", F.lit("below_dropped")), ["seq", "path"], "left")
    rows = rows.withColumn("reason", F.coalesce("own", "_below")).where("reason is not null")
    return rows.groupBy("path", "version").agg(F.min_by("reason", "seq").alias("reason"), F.sort_array(F.collect_set("seq")).alias("snapshots"))


def bad_versions(versions: DataFrame, promised: DataFrame, failed: DataFrame) -> DataFrame:
    """version, reason of versions (version, kind) that cannot be kept, the first in this order: manifests
    promise different attributes (version, attributes); none does; the content of a file fails (version)."""
    told = promised.groupBy("version").agg(F.count_distinct("attributes").alias("n"))
    rows = versions.join(told, "version", "left").join(failed.select("version").distinct().withColumn("_failed", F.lit(True)), "version", "left")
    reason = F.when(F.col("n") > 1, "attribute_conflict").when(F.col("n").isNull(), "no_attributes").when(F.col("_failed") & (F.col("kind") != "directory"), "content")
    return rows.select("version", reason.alias("reason")).where("reason is not null")


def promised_attributes(promised: DataFrame, reachable: DataFrame) -> DataFrame:
    """version, attributes, fault of every reachable version: its one promise; `duplicate` where it is
    introduced twice (even alike), `missing` where nowhere."""
    told = promised.groupBy("version").agg(F.count("*").alias("n"), F.any_value("attributes").alias("attributes"))
    rows = reachable.select("version").distinct().join(told, "version", "left")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
    return rows.select("version", F.when(F.col("n") == 1, F.col("attributes")).alias("attributes"), fault.alias("fault"))


def suppliers(catalogs: DataFrame) -> DataFrame:
    """seq, catalog_seq: of the catalogs that open, the latest that holds a snapshot supplies it."""
    return catalogs.where("opens").groupBy("seq").agg(F.max("catalog_seq").alias("catalog_seq"))


def lost_snapshots(seqs: DataFrame, supplied: DataFrame, errors: DataFrame, first_trusted: int | None) -> DataFrame:
    """seq, reason of snapshots that no catalog supplies: the error of opening the commit itself (seq, code),
    else that the chain breaks above it, else that no catalog holds it."""
    rows = seqs.select("seq").join(supplied.select("seq"), "seq", "left_anti").join(errors.select("seq", "code"), "seq", "left")
    below = F.when(F.col("seq") < first_trusted, "below the chain break") if first_trusted is not None else F.lit(None).cast("string")
    return rows.select("seq", F.coalesce("code", below, F.lit("no catalog holds it")).alias("reason"))


def outcome(snapshots: DataFrame, lost: DataFrame, left_out: DataFrame) -> DataFrame:
    """outcome, exit_code: whether a repair keeps everything, a part, or nothing."""
    n = snapshots.agg(F.count("*").alias("kept")).crossJoin(lost.agg(F.count("*").alias("lost"))).crossJoin(left_out.agg(F.count("*").alias("omitted")))
    kind = F.when(F.col("kept") == 0, "nothing").when((F.col("lost") > 0) | (F.col("omitted") > 0), "partial").otherwise("complete")
    n = n.withColumn("outcome", kind)
    return n.select("outcome", F.when(F.col("outcome") == "complete", 0).when(F.col("outcome") == "partial", 2).otherwise(1).cast("long").alias("exit_code"))


def head_choice(manifests: DataFrame) -> DataFrame:
    """head_hash, problem: the manifest to recover from, of those that decode (archive, kind, seq, hash). There
    must be one archive, some delta, and one delta at the highest number."""
    deltas = manifests.where("kind = 'delta'")
    top = deltas.agg(F.max("seq").alias("top"))
    tops = deltas.join(top, F.col("seq") == F.col("top")).agg(F.count("*").alias("n"), F.min("hash").alias("hash"))
    rows = manifests.agg(F.count_distinct("archive").alias("archives"), F.count_if(F.col("kind") == "delta").alias("deltas")).crossJoin(tops)
    problem = F.when(F.col("archives") == 0, "no_manifests").when(F.col("archives") > 1, "several_archives").when(F.col("deltas") == 0, "no_delta").when(F.col("n") != 1, "several_heads")
    rows = rows.withColumn("problem", problem)
    return rows.select(F.when(F.col("problem").isNull(), F.col("hash")).alias("head_hash"), "problem")


def manifest_chain(manifests: DataFrame, head_hash: str) -> DataFrame:
    """seq, hash of the manifests that links of hashes join to the head, and `broken` at the one whose parent
    is not there: a delta of the same archive at the number that the link says.

    Links that hold are found by one join for all manifests. A chain's numbers count down by one with each
    link, so it reaches as far down as links hold without a gap: no walk, one window over the archive.
    """
    deltas = manifests.where("kind = 'delta'").select("archive", "seq", "hash", "parent_hash", "parent_seq")
    parents = deltas.select(F.col("archive").alias("p_archive"), F.col("seq").alias("p_seq"), F.col("hash").alias("parent_hash"))
    met = (F.col("p_archive") == F.col("archive")) & (F.col("p_seq") == F.col("parent_seq"))
    linked = deltas.join(parents, "parent_hash", "left").withColumn("ok", F.coalesce(met, F.lit(False)))
    # Where several deltas bear a number, only those that the next one names are on the chain.
    named = linked.where("ok").select(F.col("parent_hash").alias("hash")).distinct().withColumn("_named", F.lit(True))
    head = linked.where(F.col("hash") == head_hash).select(F.col("archive").alias("_archive"), F.col("seq").alias("_top"))
    rows = linked.join(named, "hash", "left").join(head, F.col("archive") == F.col("_archive"))
    rows = rows.where((F.col("hash") == head_hash) | (F.col("_named") & (F.col("seq") < F.col("_top"))))
    above = Window.partitionBy("archive").orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_cut", F.max(F.when(~F.col("ok"), F.col("seq"))).over(above)).where("_cut is null")
    return rows.select("seq", "hash", (~F.col("ok") & F.col("parent_hash").isNotNull()).alias("broken"), F.col("parent_hash").isNull().alias("baseline"))


def recovered_range(chain: DataFrame, failed: DataFrame) -> DataFrame:
    """first, last, chain_start, broken_at: what the chain rebuilds: from its earliest baseline up to the
    commit before the first manifest that cannot be applied (seq); null without a baseline."""
    base = chain.agg(F.min(F.when(F.col("baseline"), F.col("seq"))).alias("base"), F.min("seq").alias("chain_start"), F.max("seq").alias("top"), F.max(F.when(F.col("broken"), F.col("seq"))).alias("broken_at"))
    stopped = failed.select(F.col("seq").alias("failing")).join(base, F.col("failing") >= F.coalesce("base", F.lit(0))).agg(F.min("failing").alias("stop"))
    rows = base.crossJoin(stopped)
    last = F.when(F.col("stop").isNull(), F.col("top")).when(F.col("stop") > F.col("base"), F.col("stop") - 1)
    rows = rows.withColumn("last", F.when(F.col("base").isNotNull(), last))
    return rows.select(F.when(F.col("last").isNotNull(), F.col("base")).alias("first"), "last", "chain_start", "broken_at")


def scope(seqs: DataFrame, first: int | None, last: int | None, any_version: bool = True) -> DataFrame:
    """seq, scope: what can be recovered of each snapshot when only first..last rebuild; without any known
    version the payload alone."""
    rest = F.lit("files" if any_version else "payload")
    kind = rest if last is None else F.when(F.col("seq") == last, "snapshot").when(F.col("seq").between(first, last), "historical").otherwise(rest)
    return seqs.select("seq", kind.alias("scope"))


def selected(entries: DataFrame, selection: DataFrame) -> DataFrame:
    """The entries at or below a selected path, and the directories above one; all if nothing is selected.

    Ancestors of both sides are unrolled and met by equality.
    """
    if selection.isEmpty():
        return entries
    below = entries.withColumn("_at", F.explode(F.array_union(paths.ancestors("path"), F.array("path")))).join(selection.select(F.col("path").alias("_at")), "_at", "left_semi").drop("_at")
    above = selection.select(F.explode(paths.ancestors("path")).alias("path"))
    return below.distinct().union(entries.join(above, "path", "left_semi").select(below.columns)).distinct()


def _taken(entries: DataFrame, key: Column) -> DataFrame:
    rows = entries.withColumns({"_parent": F.coalesce(paths.parent("path"), F.lit("")), "_key": key})
    order = Window.partitionBy("_parent", "_key").orderBy("path")
    return rows.withColumns({"_place": F.row_number().over(order), "winner": F.first("path").over(order)})


def collisions(entries: DataFrame) -> DataFrame:
    """path, winner of names that differ from an earlier sibling's only in case; a name that cannot be
    used takes no place."""
    usable = entries.withColumn("_name", paths.name("path")).where(paths.windows_issue("_name").isNull()).drop("_name")
    return _taken(usable, F.lower(paths.name("path"))).where("_place > 1").select("path", "winner")


def preflight(entries: DataFrame) -> DataFrame:
    """path, exception of entries that a restore on a destination without case leaves out: names that cannot
    be used, then collisions, and below either their whole subtrees, which is told first."""
    rows = entries.withColumn("_issue", paths.windows_issue_of(paths.name("path")))
    own = rows.where("_issue is not null").select("path", F.concat(F.lit("name: "), "_issue").alias("own")).unionByName(collisions(entries).select("path", F.lit("collision").alias("own")))
    left = entries.select("path", F.explode(paths.ancestors("path")).alias("_at")).where("_at <> path").join(own.select(F.col("path").alias("_at")), "_at", "left_semi").select("path").distinct()
    out = own.join(left.withColumn("parent", F.lit("parent_not_restored")), "path", "full_outer")
    return out.select("path", F.coalesce("parent", "own").alias("exception"))
