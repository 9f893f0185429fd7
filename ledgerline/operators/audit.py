"""Verification of a catalog as one table of findings, by levels that each include those before.

A finding is (level, check, code, seq, key). Every check is a table of its own, so a level is a union of
those up to it; nothing aborts at the first fault.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import extents as extent_ops
from . import health, timeline

# The levels from the least to the most thorough.
LEVELS = ("structural", "referential", "stored", "content", "restoration")
#: Ids that a manifest's required features may bear.
KNOWN_FEATURES = (1, 2, 3)


def finding(rows: DataFrame, level: str, check: str, code: str, seq: str | None = None, key: str | None = None) -> DataFrame:
    return rows.select(
        F.lit(level).alias("level"),
        F.lit(check).alias("check"),
        F.lit(code).alias("code"),
        (F.col(seq) if seq else F.lit(None)).cast("long").alias("seq"),
        (F.col(key) if key else F.lit(None)).cast("string").alias("key"),
    )


def findings(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


def upto(found: DataFrame, level: str) -> DataFrame:
    """The findings of a level and those below it."""
    return found.where(F.col("level").isin(*LEVELS[: LEVELS.index(level) + 1]))


def catalog(ops: DataFrame, commits: DataFrame, entries: DataFrame, versions: DataFrame, extents: DataFrame, ordinal: str, chunks: DataFrame, head: int) -> DataFrame:
    """What a catalog can tell of itself: its chain, the numbers of operations, what they name and delete,
    where entries lie, and the extents of every version. `entries` carries kinds."""
    unknown = ops.where("op = 'put'").join(versions.select("version"), "version", "left_anti")
    lost = extents.where("chunk_id is not null").join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("version").distinct()
    ranges = timeline.containment_ranges(entries, head)
    return findings(
        [
            finding(timeline.chain_faults(commits), "structural", "chain", "CATALOG_INVALID", "seq"),
            finding(timeline.sequence_faults(ops, "op_seq"), "structural", "op_sequence", "CATALOG_INVALID", "seq", "op_seq"),
            finding(unknown, "referential", "unknown_version", "CATALOG_INVALID", "seq", "version"),
            finding(timeline.delete_faults(ops), "referential", "delete_missing", "NAMESPACE_INVALID", "seq", "path"),
            finding(ranges, "referential", "containment", "NAMESPACE_INVALID", "first", "path"),
            finding(lost, "referential", "extent_chunk", "REFERENCE_INVALID", None, "version"),
            finding(extent_ops.defects(extents, versions, ordinal), "referential", "extents", "EXTENT_INVALID", None, "version"),
        ]
    )


def first_of_each(found: DataFrame) -> DataFrame:
    """The finding of each check that comes first, by commit and key, as a reader meets it who stops there."""
    order = Window.partitionBy("check").orderBy(F.col("seq").asc_nulls_last(), "key")
    return found.withColumn("_k", F.row_number().over(order)).where("_k = 1").drop("_k")


def verdict(found: DataFrame, level: str) -> DataFrame:
    """level, violations, unsupported, operational, integrity, recoverability: what the findings up to a level
    conclude. Recoverability is known only where contents were read."""
    rows = upto(found, level).withColumn("class", health.error_class("code"))
    sums = rows.agg(*[F.count_if(F.col("class") == c).alias(n) for c, n in (("violation", "violations"), ("unsupported", "unsupported"), ("operational", "operational"))])
    broken = F.when(F.col("violations") > 0, "FAIL").when(F.col("unsupported") > 0, "UNSUPPORTED").when(F.col("operational") > 0, "UNKNOWN")
    read = F.coalesce(broken, F.lit("PASS" if LEVELS.index(level) >= 2 else "UNKNOWN"))
    whole = F.coalesce(broken, F.lit("PASS" if level == "restoration" else "UNKNOWN"))
    return sums.select(F.lit(level).alias("level"), "violations", "unsupported", "operational", read.alias("integrity"), whole.alias("recoverability"))


def append_faults(commits: DataFrame, head: int) -> DataFrame:
    """seq, fault of commits (seq, parent_seq) that cannot follow the head: the parent is another one, or the
    number not above the head's."""
    fault = F.when(~F.col("parent_seq").eqNullSafe(F.lit(head)), "other_parent").when(F.col("seq") <= head, "not_after_head")
    return commits.select("seq", fault.alias("fault")).where("fault is not null")


def shape_faults(deltas: DataFrame, head: int) -> DataFrame:
    """seq, fault of delta manifests (seq, kind, parent_seq, features) that cannot be replayed one after another
    on the head: the kind, the number, the parent, features that nobody knows."""
    before = F.coalesce(F.lag("seq").over(Window.orderBy("seq")), F.lit(head))
    rows = deltas.withColumn("_before", before)
    known = F.array(*map(F.lit, KNOWN_FEATURES))
    fault = (
        F.when(F.col("kind") != "delta", "not_a_delta")
        .when(F.col("seq") != F.col("_before") + 1, "sequence")
        .when(~F.col("parent_seq").eqNullSafe(F.col("_before")), "parent")
        .when(F.size(F.array_except("features", known)) > 0, "unsupported_feature")
    )
    return rows.select("seq", fault.alias("fault")).where("fault is not null")


def introduction_faults(introduced: DataFrame, held: DataFrame) -> DataFrame:
    """seq, kind, id of what deltas introduce (seq, kind, id) though it exists: in the catalog (kind, id) or in
    an earlier place of the deltas. Using a thing again is none; listing it again is, alike or not."""
    order = Window.partitionBy("kind", "id").orderBy("seq", "place")
    rows = introduced.withColumn("_again", F.row_number().over(order) > 1).join(held.select("kind", "id").distinct().withColumn("_held", F.lit(True)), ["kind", "id"], "left")
    return rows.where("_again or _held").select("seq", "kind", "id")


def delta_references(ops: DataFrame, introduced: DataFrame, held: DataFrame) -> DataFrame:
    """seq, op_seq, version of puts (seq, op_seq, op, version) whose version neither the catalog (version) nor a
    delta up to theirs introduces (seq, version)."""
    known = introduced.select("version", "seq").unionByName(held.select("version", F.lit(-1).cast("long").alias("seq"))).groupBy("version").agg(F.min("seq").alias("since"))
    rows = ops.where("op = 'put'").join(known, "version", "left")
    return rows.where("since is null or since > seq").select("seq", "op_seq", "version")


def first_failing(*faults: DataFrame) -> DataFrame:
    """seq: the first commit that any check (seq) refuses; a replay keeps what lies before."""
    return reduce(DataFrame.union, [f.select("seq") for f in faults]).agg(F.min("seq").alias("seq"))


def work_bound(ops: DataFrame, introduced: DataFrame, extents: DataFrame) -> DataFrame:
    """seq and the most work that replaying its manifest takes: lookups and changes of catalog rows, probes and
    changes of entries. A sum of fixed costs over operations (seq, op), introductions (seq, kind, dependencies,
    located) and the extents of introduced versions (seq; n of them in a row, where that column is there); it
    never depends on the catalog."""
    # Lookups, row changes, probes and entry changes of each item.
    costs = {"put": (1, 1, 5, 1), "delete": (0, 1, 4, 1), "manifest": (0, 1, 0, 0), "chunk": (2, 2, 0, 0), "version": (2, 1, 0, 0), "extent": (1, 1, 0, 0), "row": (0, 1, 0, 0)}
    names = ("catalog_lookups", "catalog_row_mutations", "namespace_probes", "namespace_entry_mutations")
    items = ops.select("seq", F.col("op").alias("item"), F.lit(1).cast("long").alias("n"))
    items = items.unionByName(introduced.select("seq", F.col("kind").alias("item"), F.lit(1).cast("long").alias("n")))
    more = F.col("dependencies") + F.when(F.col("located"), 1).otherwise(0)
    items = items.unionByName(introduced.where("kind = 'chunk'").select("seq", F.lit("row").alias("item"), more.cast("long").alias("n")))
    many = F.col("n") if "n" in extents.columns else F.lit(1)
    items = items.unionByName(extents.select("seq", F.lit("extent").alias("item"), many.cast("long").alias("n")))
    cost = lambda k: F.coalesce(reduce(lambda c, x: c.when(F.col("item") == x[0], F.col("n") * x[1][k]), costs.items(), F), F.lit(0))
    # A commit has one manifest, whatever its items.
    sums = items.groupBy("seq").agg(*[F.try_sum(cost(k)).alias(n) for k, n in enumerate(names)])
    return sums.select("seq", *[F.coalesce(F.expr(f"try_add({n}, {costs['manifest'][k]}L)"), F.lit((1 << 63) - 1)).alias(n) for k, n in enumerate(names)])


def limit_faults(values: DataFrame, limits: dict[str, int]) -> DataFrame:
    """key, limit of rows whose value exceeds a limit (columns named as the limits)."""
    over = F.array_compact(F.array(*[F.when(F.col(name) > most, F.lit(name)) for name, most in limits.items()]))
    return values.select("key", F.explode(over).alias("limit"))


def key_set_faults(ops: DataFrame, most: int = 16) -> DataFrame:
    """seq, op_seq, fault of key operations (seq, op_seq, op, id): adding what is there, removing what is not,
    leaving none, or holding more than `most`. The first fault of a log counts; what follows it is undecided."""
    by_id = Window.partitionBy("id").orderBy("seq", "op_seq")
    before = F.lag("op").over(by_id)
    running = Window.orderBy("seq", "op_seq").rowsBetween(Window.unboundedPreceding, 0)  # a log holds few key operations
    rows = ops.withColumn("_before", before).withColumn("_held", F.sum(F.when(F.col("op") == "add", 1).otherwise(-1)).over(running))
    fault = (
        F.when((F.col("op") == "add") & (F.col("_before") == "add"), "already_there")
        .when((F.col("op") == "remove") & (F.col("_before").isNull() | (F.col("_before") == "remove")), "not_there")
        .when((F.col("op") == "remove") & (F.col("_held") <= 0), "none_left")
        .when(F.col("_held") > most, "too_many")
    )
    return rows.withColumn("fault", fault).where("fault is not null").orderBy("seq", "op_seq").limit(1).select("seq", "op_seq", "fault")


def key_set(ops: DataFrame) -> DataFrame:
    """id of the keys in force: those last added."""
    last = ops.groupBy("id").agg(F.max_by("op", F.struct("seq", "op_seq")).alias("op"))
    return last.where("op = 'add'").select("id")


def weak_keys(envelopes: DataFrame, memory: int, passes: int) -> DataFrame:
    """id of envelopes (id, kdf_memory, kdf_passes) whose derivation costs less than the default."""
    return envelopes.where((F.col("kdf_memory") < memory) | (F.col("kdf_passes") < passes)).select("id")
