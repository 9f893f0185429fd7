"""Segments of a history: checkpoints, the deltas after them, and when the next checkpoint is due.

Where commits of several archives are in one table, the operators take the columns that tell these apart.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_base(commits: DataFrame, *archive: str) -> DataFrame:
    """Adds base_seq: the last checkpoint up to the commit."""
    upto = Window.partitionBy(*archive).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return commits.withColumn("base_seq", F.last(F.when(F.col("is_checkpoint"), F.col("seq")), ignorenulls=True).over(upto))


def accounting(commits: DataFrame, *archive: str) -> DataFrame:
    """base_seq, base_bytes, deltas, delta_bytes of every segment."""
    rows = with_base(commits, *archive)
    return rows.groupBy(*archive, "base_seq").agg(
        F.sum(F.when(F.col("is_checkpoint"), F.col("bytes")).otherwise(0)).alias("base_bytes"),
        F.sum(F.when(F.col("is_checkpoint"), 0).otherwise(1)).cast("long").alias("deltas"),
        F.sum(F.when(F.col("is_checkpoint"), 0).otherwise(F.col("bytes"))).alias("delta_bytes"),
    )


def schedule(commits: DataFrame, floor: int, numerator: int = 1, denominator: int = 1) -> DataFrame:
    """archive, seq, fires: a commit becomes a checkpoint where the deltas before it weigh at least as
    much as the segment's base (or the floor), or where it is `forced`. Each firing resets the sum, so an
    archive is folded in order."""
    forced = "forced" in commits.columns

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        base, deltas, fires = 0, 0, []
        told = rows["forced"] if forced else [False] * len(rows)
        for k, (size, must) in enumerate(zip(rows["bytes"], told, strict=True)):
            fire = k == 0 or bool(must) or deltas * denominator >= max(base, floor) * numerator
            fires.append(fire)
            base, deltas = (int(size), 0) if fire else (base, deltas + int(size))
        return pd.DataFrame({"archive": rows["archive"], "seq": rows["seq"], "fires": fires})

    return commits.groupBy("archive").applyInPandas(fold, "archive long, seq long, fires boolean")


def faults(commits: DataFrame, *archive: str) -> DataFrame:
    """seq, fault of commits (seq, commit_id, parent_id, parent_seq, is_checkpoint, named_base, descriptor,
    encrypted) whose segment is not sound; the first in this order counts: the link to the commit before,
    its number, the base that a delta names, one descriptor and one profile in a segment."""
    order = Window.partitionBy(*archive).orderBy("seq")
    rows = with_base(commits, *archive).withColumns({"before_id": F.lag("commit_id").over(order), "before": F.lag("seq").over(order)})
    base = rows.where("is_checkpoint").select(*archive, F.col("seq").alias("base_seq"), F.col("descriptor").alias("base_descriptor"), F.col("encrypted").alias("base_encrypted"))
    rows = rows.join(base, [*archive, "base_seq"], "left")
    linked = F.col("parent_id").eqNullSafe(F.col("before_id")) & F.col("parent_seq").eqNullSafe(F.col("before"))
    delta = ~F.col("is_checkpoint")
    fault = (
        F.when(~linked, "not_linked")
        .when(F.col("before").isNotNull() & (F.col("seq") != F.col("before") + 1), "not_contiguous")
        .when(delta & F.col("base_seq").isNull(), "no_checkpoint")
        .when(delta & ~F.col("named_base").eqNullSafe(F.col("base_seq")), "other_base")
        .when(delta & (F.col("descriptor") != F.col("base_descriptor")), "other_descriptor")
        .when(delta & (F.col("encrypted") != F.col("base_encrypted")), "other_profile")
    )
    return rows.select(*archive, "seq", fault.alias("fault")).where("fault is not null")


def delta_link_faults(deltas: DataFrame, *archive: str) -> DataFrame:
    """seq of deltas (seq, delta_hash, parent_hash) that do not name the delta of the commit before, be that
    a checkpoint or not; the first of an archive names none."""
    before = F.lag("delta_hash").over(Window.partitionBy(*archive).orderBy("seq"))
    return deltas.withColumn("_before", before).where(~F.col("parent_hash").eqNullSafe(F.col("_before"))).select(*archive, "seq")


def base_hints(commits: DataFrame, *archive: str) -> DataFrame:
    """seq, hint of deltas whose hint of where their base lies is wrong. That is advice, not a fault."""
    rows = with_base(commits, *archive)
    base = rows.where("is_checkpoint").select(*archive, F.col("seq").alias("base_seq"), F.col("footer_offset").alias("base_offset"))
    return rows.where("not is_checkpoint").join(base, [*archive, "base_seq"]).where("base_hint <> base_offset").select(*archive, "seq", F.col("base_hint").alias("hint"))


def unrecoverable(references: DataFrame, commits: DataFrame, introduced: DataFrame, held: DataFrame) -> DataFrame:
    """base_seq, first_failing: per segment the first commit that refers to something (seq, id) which is
    neither in the base's snapshot (base_seq, id) nor introduced (seq, id) in the segment up to it."""
    based = with_base(commits).select("seq", "base_seq")
    used = references.join(based, "seq")
    known = introduced.join(based, "seq").groupBy("base_seq", "id").agg(F.min("seq").alias("since"))
    known = known.unionByName(held.select("base_seq", "id", F.col("base_seq").alias("since"))).groupBy("base_seq", "id").agg(F.min("since").alias("since"))
    missing = used.join(known, ["base_seq", "id"], "left").where("since is null or since > seq")
    return missing.groupBy("base_seq").agg(F.min("seq").alias("first_failing"))
