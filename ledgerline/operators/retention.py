"""Retention and garbage collection: roots, marked and collectable snapshots, versions and chunks, rewrites."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timeline import chunks_of, dealt, seen_by

# Fixed value: why a snapshot can be collected.
REASON = "expired; not the head; no active hold"
_MOST = (1 << 63) - 1


def replay(ops: DataFrame) -> DataFrame:
    """key, kind, valid, seq of every retention operation: holding a held label, releasing a free one
    and expiring a snapshot twice are faults."""
    order = Window.partitionBy("family", "key").orderBy("op_id")
    previous = F.lag("kind").over(order)
    fault = (
        F.when((F.col("kind") == "hold") & (previous == "hold"), "duplicate_hold")
        .when((F.col("kind") == "release") & (previous.isNull() | (previous == "release")), "inactive_label")
        .when((F.col("kind") == "expire") & previous.isNotNull(), "expired_twice")
    )
    return ops.withColumn("fault", fault)


def operation_faults(ops: DataFrame) -> DataFrame:
    """op_id, fault of operations (op_id, seq, kind, target, label) that cannot stand whatever came before:
    expiring the commit itself or a later one, holding a later one, labels that are empty or too long."""
    fault = (
        F.when((F.col("kind") == "expire") & (F.col("target") >= F.col("seq")), "expires_head")
        .when((F.col("kind") == "hold") & (F.col("target") > F.col("seq")), "holds_future")
        .when(F.col("kind").isin("hold", "release") & ~F.coalesce(F.octet_length("label"), F.lit(0)).between(1, 255), "label_length")
    )
    return ops.select("op_id", fault.alias("fault")).where("fault is not null")


def accepted(ops: DataFrame) -> DataFrame:
    """seq of the commits whose retention operations hold: a fault refuses the whole commit, and what it
    would have changed. Only the first refusal of an archive is certain, so commits from it on are out."""
    faulty = replay(ops).where("fault is not null").agg(F.min("seq").alias("refused"))
    return ops.select("seq").distinct().join(faulty, F.col("refused").isNull() | (F.col("seq") < F.col("refused"))).select("seq")


def holds(ops: DataFrame) -> DataFrame:
    """label, seq of the holds in force: the last operation of each label, if that holds."""
    last = ops.where("family = 'label'").groupBy("key").agg(F.max_by(F.struct("kind", "seq"), "op_id").alias("last"))
    return last.where("last.kind = 'hold'").select(F.col("key").alias("label"), F.col("last.seq").alias("seq"))


def roots(seqs: DataFrame, expired: DataFrame, held: DataFrame, head: int) -> DataFrame:
    """seq of every snapshot that is kept: the head, those not expired, those held."""
    kept = seqs.where(F.col("seq") <= head).join(expired, "seq", "left_anti")
    return kept.select("seq").union(held.select("seq").where(F.col("seq") <= head)).union(seqs.where(F.col("seq") == head).select("seq")).distinct()


def mark(entries: DataFrame, kept: DataFrame, extents: DataFrame, head: int, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Versions live in a kept snapshot, and the chunks that they use; in so many parts by version and chunk."""
    versions = dealt(seen_by(entries, head, kept).select("version"), parts, "version").distinct()
    return versions, chunks_of(versions, extents, parts).distinct()


def collectable(chunks: DataFrame, used: DataFrame, referenced: DataFrame | None = None) -> DataFrame:
    """chunk_id of the chunks that are not used; with `referenced`, only those that are named there. All meet in one aggregation."""
    roles = ("held", "used", "named")
    role = lambda rows, name: rows.select("chunk_id", *[F.lit(r == name).alias(r) for r in roles])
    rows = role(chunks, "held").unionByName(role(used, "used"))
    if referenced is not None:
        rows = rows.unionByName(role(referenced, "named"))
    met = rows.groupBy("chunk_id").agg(*[F.max(r).alias(r) for r in roles])
    return met.where("held and not used" + (" and named" if referenced is not None else "")).select("chunk_id")


def unsupported(marked: DataFrame, dependencies: DataFrame) -> DataFrame:
    """chunk_id of marked chunks that depend on others: collecting these is refused."""
    return marked.join(dependencies.select("chunk_id").distinct(), "chunk_id", "left_semi")


def totals(marked: DataFrame, everything: DataFrame, key: str, referenced: DataFrame | None = None) -> DataFrame:
    """class, n, bytes: what is retained and what can be collected. Sums that overflow stay at the largest value.

    With `referenced` (key), what no version at all uses is the framing of streams, which a rewrite makes anew.
    """
    rows = everything.join(marked.select(key).withColumn("_kept", F.lit(True)), key, "left")
    kind = F.when(F.col("_kept"), "retained")
    if referenced is not None:
        rows = rows.join(referenced.select(key).distinct().withColumn("_used", F.lit(True)), key, "left")
        kind = kind.when(F.col("_used").isNull(), "stream_framing")
    rows = rows.withColumn("class", kind.otherwise("collectable"))
    return rows.groupBy("class").agg(F.count("*").alias("n"), F.coalesce(F.try_sum("bytes"), F.lit(_MOST)).alias("bytes"))


@dataclass
class Plan:
    """A collection plan: what is kept, what is not, and why."""

    roots: DataFrame  # seq
    expired: DataFrame  # seq
    holds: DataFrame  # label, seq
    snapshots: DataFrame  # seq, reason: collectable
    totals: DataFrame  # kind (version, chunk), class, n, bytes
    versions: DataFrame  # version: collectable
    chunks: DataFrame  # chunk_id: collectable
    refused: DataFrame  # chunk_id: marked chunks with dependencies; any row refuses the plan


def plan(entries: DataFrame, seqs: DataFrame, ops: DataFrame, versions: DataFrame, chunks: DataFrame, extents: DataFrame, dependencies: DataFrame, head: int, streams: bool = False, parts: int | None = None) -> Plan:
    """The plan at `head`, from the catalog (versions: version; chunks: chunk_id, bytes) and the retention operations;
    `parts` as in `timeline.dealt`, of versions, extents and chunks."""
    expired = ops.where("kind = 'expire'").select(F.col("target").alias("seq")).distinct()
    held = holds(ops.withColumn("seq", F.col("target")))
    kept = roots(seqs, expired, held, head)
    marked, used = mark(entries, kept, extents, head, parts)
    referenced = dealt(extents.where("chunk_id is not null").select("chunk_id"), parts, "chunk_id") if streams else None
    versions, chunks = dealt(versions.select("version"), parts, "version"), dealt(chunks.select("chunk_id", "bytes"), parts, "chunk_id")
    by_version = totals(marked, versions.select("version").withColumn("bytes", F.lit(0).cast("long")), "version").withColumn("kind", F.lit("version"))
    by_chunk = totals(used, chunks.select("chunk_id", "bytes"), "chunk_id", referenced).withColumn("kind", F.lit("chunk"))
    return Plan(
        roots=kept,
        expired=expired,
        holds=held,
        snapshots=seqs.where(F.col("seq") <= head).select("seq").join(kept, "seq", "left_anti").withColumn("reason", F.lit(REASON)),
        totals=by_version.unionByName(by_chunk),
        versions=versions.select("version").join(marked, "version", "left_anti"),
        chunks=collectable(chunks, used, referenced),
        refused=unsupported(used, dependencies),
    )


def renumbered(kept: DataFrame) -> DataFrame:
    """seq, new_seq of a rewrite that keeps these snapshots."""
    return kept.withColumn("new_seq", (F.row_number().over(Window.orderBy("seq")) - 1).cast("long"))


def rewritten(entries: DataFrame, kept: DataFrame, head: int) -> DataFrame:
    """new_seq, op_seq, op, path, version: the operations of a rewrite that has one commit for each kept
    snapshot. Each makes its snapshot of the one kept before it: deletes first, then puts, by path.

    An entry begins at the first kept snapshot of its life and ends at the first kept one after it; where
    the path goes on with another version there, no delete is needed.
    """
    numbers = renumbered(kept)
    seqs = entries.sparkSession.range(head + 2).select(F.col("id").alias("at"))
    ahead = Window.orderBy("at").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    following = seqs.join(numbers.withColumnRenamed("seq", "at"), "at", "left").withColumn("new_at", F.min("new_seq").over(ahead)).select("at", "new_at")
    rows = entries.where(F.col("live_from") <= head).join(following.select(F.col("at").alias("live_from"), F.col("new_at").alias("begin")), "live_from")
    rows = rows.withColumn("at", F.least(F.coalesce("live_to", F.lit(head + 1)), F.lit(head + 1)).cast("long")).join(following.withColumnRenamed("new_at", "end"), "at")
    rows = rows.where("begin is not null and (end is null or begin < end)")  # seen by a kept snapshot
    order = Window.partitionBy("path").orderBy("begin")
    rows = rows.withColumns({"held": F.lag("version").over(order), "held_to": F.lag("end").over(order), "then": F.lead("begin").over(order)})
    puts = rows.where("not (held <=> version and held_to <=> begin)").select(F.col("begin").alias("new_seq"), F.lit("put").alias("op"), "path", "version")
    deletes = rows.where("end is not null and not (then <=> end)").select(F.col("end").alias("new_seq"), F.lit("delete").alias("op"), "path", F.lit(None).cast("long").alias("version"))
    both = puts.unionByName(deletes)
    place = Window.partitionBy("new_seq").orderBy(F.col("op") != "delete", "path")
    return both.withColumn("op_seq", (F.row_number().over(place) - 1).cast("long"))


def carried(state: DataFrame, numbers: DataFrame) -> DataFrame:
    """kind, label, seq, new_seq of holds and expiries (kind, label, seq) after a rewrite: holds are all
    listed, those of snapshots that are gone without a new number; expiries only of kept snapshots."""
    rows = state.join(numbers, "seq", "left")
    return rows.where("kind = 'hold' or new_seq is not null").select("kind", "label", "seq", "new_seq")
