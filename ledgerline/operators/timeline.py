"""Replay of an operation log as intervals: snapshots, differences, and the faults of a history.

`op_seq` orders the operations of a commit; it may be any type that sorts. Windows without a key stand
over one row for each commit alone, or take the column that tells archives apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import paths

#: Commits that share a row of wanted snapshots when intervals meet them.
BLOCK = 64
#: Rows that are dealt to one task where it holds what it takes.
TASK_ROWS = 250_000


def parts_of(rows: DataFrame) -> int:
    """How many parts of TASK_ROWS rows a table makes, by a count that the footers of Parquet files answer; up to
    a part for each core where rows are few."""
    n = rows.count()
    return max(1, -(-n // TASK_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, n // 10_000))


def dealt(rows: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """The rows in so many parts by their keys, so that no task holds more of a larger table; without a number, as they are."""
    return rows if parts is None else rows.repartition(parts, *keys)


def with_previous(ops: DataFrame) -> DataFrame:
    """Adds what the operation before did to the same path."""
    return ops.withColumn("previous", F.lag("op").over(Window.partitionBy("path").orderBy("seq", "op_seq")))


def delete_faults(ops: DataFrame) -> DataFrame:
    """Deletes of a path that is absent when their turn comes."""
    return with_previous(ops).where("op = 'delete' and (previous is null or previous = 'delete')").drop("previous")


def valid_log(ops: DataFrame) -> DataFrame:
    return with_previous(ops).where("not (op = 'delete' and (previous is null or previous = 'delete'))").drop("previous")


def intervals(log: DataFrame) -> DataFrame:
    """path, version, live_from, live_to (null: still live): what each path holds, commit by commit.

    The last operation of a path in a commit decides. A delete of an absent path changes nothing, so
    the log need not be cleaned before; one shuffle by path serves the whole replay.
    """
    order = Window.partitionBy("path").orderBy("seq", "op_seq")
    rows = log.withColumn("live_to", F.lead("seq").over(order))
    return rows.where("op = 'put' and (live_to is null or live_to <> seq)").select("path", "version", F.col("seq").alias("live_from"), "live_to")


def _last(upto: str) -> str:
    return f"max_by(struct(op, version), struct(seq, op_seq)) filter (where {upto})"


def snapshot(log: DataFrame, seq: int | None = None) -> DataFrame:
    """path, version at a commit or at the head: the last operation of each path up to it, by one aggregation."""
    last = (log if seq is None else log.where(F.col("seq") <= seq)).groupBy("path").agg(F.expr(_last("true")).alias("last"))
    return last.where("last.op = 'put'").select("path", F.col("last.version").alias("version"))


def two_snapshots(log: DataFrame, before: int, after: int | None = None) -> DataFrame:
    """path, old, new: the versions at two commits, or at one and the head, null where the path is absent, in
    one pass over the log."""
    if after is not None:
        log = log.where(F.col("seq") <= max(before, after))
    last = log.groupBy("path").agg(F.expr(_last(f"seq <= {before}")).alias("a"), F.expr(_last("true" if after is None else f"seq <= {after}")).alias("b"))
    held = lambda c: F.when(F.col(f"{c}.op") == "put", F.col(f"{c}.version"))
    return last.select("path", held("a").alias("old"), held("b").alias("new"))


def in_snapshots(entries: DataFrame, head: int, wanted: DataFrame | None = None) -> DataFrame:
    """A row for each commit up to `head` at which an entry is live; `wanted` (seq) restricts the commits.

    Wanted commits are gathered by blocks of them; an entry meets the blocks that its interval touches, by
    equality, and takes from each the commits within. So what an entry costs is its hits and one row for
    every BLOCK commits that it lives, and no join becomes a nested loop.
    """
    stop = F.least(F.coalesce("live_to", F.lit(head + 1)), F.lit(head + 1)).cast("long")
    rows = entries.where(F.col("live_from") <= head).withColumn("_stop", stop)
    if wanted is None:
        return rows.withColumn("seq", F.explode(F.sequence(F.col("live_from"), F.col("_stop") - 1))).drop("_stop")
    blocks = wanted.where(F.col("seq") <= head).select("seq", F.expr(f"seq div {BLOCK}").alias("_block")).groupBy("_block").agg(F.collect_set("seq").alias("_seqs"))
    rows = rows.withColumn("_block", F.explode(F.expr(f"sequence(live_from div {BLOCK}, (_stop - 1) div {BLOCK})"))).join(blocks, "_block")
    return rows.withColumn("seq", F.explode(F.expr("filter(_seqs, s -> s >= live_from and s < _stop)"))).drop("_block", "_seqs", "_stop")


def seen_by(entries: DataFrame, head: int, wanted: DataFrame) -> DataFrame:
    """The entries that are live at any wanted commit up to `head`, each once.

    An entry is, where the first wanted commit from its beginning on lies before its end; that is a row for each
    commit, which one task orders and every task gets.
    """
    seqs = entries.sparkSession.range(head + 1).select(F.col("id").alias("live_from"))
    marks = wanted.where(F.col("seq") <= head).select(F.col("seq").alias("live_from"), F.col("seq").alias("at")).distinct()
    ahead = Window.orderBy("live_from").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    following = seqs.join(marks, "live_from", "left").withColumn("_next", F.min("at").over(ahead)).drop("at").where("_next is not null")
    return entries.join(F.broadcast(following), "live_from").where("live_to is null or _next < live_to").drop("_next")


def counts(entries: DataFrame, head: int) -> DataFrame:
    """seq, entries, versions live at every commit that has some: running sums of what begins and ends."""
    order = Window.partitionBy("version").orderBy("live_from", F.col("live_to").asc_nulls_last())
    far = F.coalesce("live_to", F.lit((1 << 62)))
    reached = F.max(far).over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = entries.withColumn("fresh", (reached.isNull() | (F.col("live_from") > reached)).cast("int"))
    islands = islands.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    islands = islands.groupBy("version", "island").agg(F.min("live_from").alias("live_from"), F.max(far).alias("live_to"))

    def changes(rows: DataFrame, name: str) -> DataFrame:
        ends = rows.where(F.col("live_to") <= head).select(F.col("live_to").alias("seq"), F.lit(-1).cast("long").alias(name))
        both = rows.where(F.col("live_from") <= head).select(F.col("live_from").alias("seq"), F.lit(1).cast("long").alias(name)).unionByName(ends)
        return both.groupBy("seq").agg(F.sum(name).alias(name))

    upto = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = entries.sparkSession.range(head + 1).withColumnRenamed("id", "seq")
    rows = rows.join(changes(entries, "entries"), "seq", "left").join(changes(islands, "versions"), "seq", "left").na.fill(0)
    return rows.select("seq", F.sum("entries").over(upto).alias("entries"), F.sum("versions").over(upto).alias("versions")).where("entries > 0")


def diff(both: DataFrame) -> DataFrame:
    """path, op, version that turn the old snapshot of `two_snapshots` into the new one."""
    op = F.when(F.col("new").isNull() & F.col("old").isNotNull(), "delete").when(F.col("new").isNotNull() & ~F.col("old").eqNullSafe(F.col("new")), "put")
    return both.select("path", op.alias("op"), F.col("new").alias("version")).where("op is not null")


def in_order(changes: DataFrame) -> DataFrame:
    """Changes as a commit applies them: deletes first, then puts, each by path."""
    return changes.orderBy(F.col("op") != "delete", "path")


def state_differences(both: DataFrame) -> DataFrame:
    """path, difference (missing_left, missing_right, changed) of the snapshots of `two_snapshots`."""
    old, new = F.col("old"), F.col("new")
    kind = F.when(old.isNull() & new.isNotNull(), "missing_left").when(new.isNull() & old.isNotNull(), "missing_right").when(old != new, "changed")
    return both.select("path", kind.alias("difference")).where("difference is not null")


def joined(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, old, new of two tables (path, version), for `diff` and `state_differences`."""
    return before.withColumnRenamed("version", "old").join(after.withColumnRenamed("version", "new"), "path", "full_outer")


def differing_snapshots(left: DataFrame, right: DataFrame) -> DataFrame:
    """seq, n: commits whose entries (seq, path, version) differ between two catalogs, and by how many rows.

    Each side is counted once for each row, so one aggregation serves both directions.
    """
    both = left.select("seq", "path", "version", F.lit(1).alias("side")).unionByName(right.select("seq", "path", "version", F.lit(-1).alias("side")))
    rows = both.groupBy("seq", "path", "version").agg(F.sum("side").alias("side")).where("side <> 0")
    return rows.groupBy("seq").agg(F.count("*").alias("n"))


def differing_entries(left: DataFrame, right: DataFrame, seqs: DataFrame) -> DataFrame:
    """seq, n: what `differing_snapshots` tells of the snapshots of two catalogs at the commits `seqs`, from their
    entries (path, version, live_from, live_to).

    Intervals that both sides have cancel out; of the rest, the balance of a path's version goes up and down in
    time, and counts where it is not zero are running sums of where that begins and ends. Nothing is unrolled.
    """
    columns = ("path", "version", "live_from", "live_to")
    both = left.select(*columns, F.lit(1).alias("side")).unionByName(right.select(*columns, F.lit(-1).alias("side")))
    rest = both.groupBy(*columns).agg(F.sum("side").alias("side")).where("side <> 0")
    turns = F.explode(F.array(F.struct(F.col("live_from").alias("seq"), F.col("side")), F.struct(F.col("live_to").alias("seq"), (-F.col("side")).alias("side"))))
    sums = rest.select("path", "version", turns.alias("turn")).where("turn.seq is not null").groupBy("path", "version", "turn.seq").agg(F.sum("turn.side").alias("side"))
    order = Window.partitionBy("path", "version").orderBy("seq")
    balance = sums.withColumn("now", F.sum("side").over(order))
    differs = lambda c: (F.coalesce(c, F.lit(0)) != 0).cast("long")
    changes = balance.select("seq", (differs(F.col("now")) - differs(F.lag("now").over(order))).alias("n"), F.lit(False).alias("asked"))
    rows = changes.unionByName(seqs.select("seq", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))).groupBy("seq").agg(F.sum("n").alias("n"), F.max("asked").alias("asked"))
    upto = Window.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("n", F.sum("n").over(upto)).where("asked and n > 0").select("seq", "n")


def chain_faults(commits: DataFrame, *archive: str) -> DataFrame:
    """Commits whose parent is not the commit before them, in each archive."""
    chain = commits.withColumn("expected", F.lag("seq").over(Window.partitionBy(*archive).orderBy("seq")))
    return chain.where(~F.col("parent_seq").eqNullSafe(F.col("expected")))


def trusted_suffix(commits: DataFrame, *archive: str) -> DataFrame:
    """Commits that whole links (`linked`) connect to the head: the walk back stops at the first break.

    A commit is trusted if no later one lacks its link; the first of all needs none.
    """
    later = Window.partitionBy(*archive).orderBy(F.desc("seq")).rowsBetween(Window.unboundedPreceding, -1)
    broken = F.max(F.when(~F.col("linked"), F.col("seq"))).over(later)
    return commits.withColumn("broken_at", broken).where("broken_at is null").drop("broken_at")


def sequence_faults(ops: DataFrame, column: str) -> DataFrame:
    """Operations whose number is not their place among those of the commit."""
    place = F.row_number().over(Window.partitionBy("seq").orderBy("op_seq")) - 1
    return ops.withColumn("expected", place.cast("long")).where(F.col(column) != F.col("expected"))


def kind_runs(entries: DataFrame) -> DataFrame:
    """path, kind, first, stop (exclusive, null: open): the stretches over which a path stays of a kind."""
    order = Window.partitionBy("path").orderBy("live_from")
    fresh = ~(F.lag("live_to").over(order).eqNullSafe(F.col("live_from")) & F.lag("kind").over(order).eqNullSafe(F.col("kind")))
    runs = entries.withColumn("_fresh", fresh.cast("int")).withColumn("_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    stop = F.when(F.count_if(F.col("live_to").isNull()) == 0, F.max("live_to"))
    return runs.groupBy("path", "kind", "_run").agg(F.min("live_from").alias("first"), stop.alias("stop")).drop("_run")


def containment_ranges(entries: DataFrame, head: int) -> DataFrame:
    """path, fault, first, stop: over which commits an entry (path, kind, live_from, live_to) has no parent
    directory; MISSING_PARENT where its parent is absent, PARENT_NOT_DIRECTORY where that is a file.

    Entries of the top level lie in the implicit root. Stretches of one kind meet by the parent's path;
    nothing is unrolled by commit.
    """
    runs = kind_runs(entries).where(F.col("first") <= head).withColumn("stop", F.least(F.coalesce("stop", F.lit(head + 1)), F.lit(head + 1)).cast("long"))
    children = runs.withColumn("parent", paths.parent("path")).where("parent is not null").select("path", "parent", "first", "stop")
    parents = runs.select(F.col("path").alias("parent"), F.col("kind").alias("p_kind"), F.col("first").alias("p_first"), F.col("stop").alias("p_stop"))
    met = children.join(parents, "parent", "left")
    within = F.when((F.col("p_first") < F.col("stop")) & (F.col("p_stop") > F.col("first")), F.struct(F.greatest("p_first", "first").alias("a"), F.least("p_stop", "stop").alias("b"), F.col("p_kind").alias("kind")))
    held = met.groupBy("path", "first", "stop").agg(F.sort_array(F.collect_list(within)).alias("held"))
    gaps = "filter(transform(sequence(0, size(held)), k -> struct(if(k = 0, first, held[k - 1].b) as a, coalesce(get(held, k).a, stop) as b, 'MISSING_PARENT' as fault)), x -> x.a < x.b)"
    gaps = gaps.replace("if(k = 0, first, held[k - 1].b)", "coalesce(get(held, k - 1).b, first)")
    files = "transform(filter(held, x -> x.kind <> 'directory'), x -> struct(x.a as a, x.b as b, 'PARENT_NOT_DIRECTORY' as fault))"
    faults = held.withColumn("x", F.explode(F.expr(f"concat({gaps}, {files})")))
    return faults.select("path", F.col("x.fault").alias("fault"), F.col("x.a").alias("first"), F.col("x.b").alias("stop"))


def containment_faults(entries: DataFrame, head: int) -> DataFrame:
    """path, seq, fault: the ranges of `containment_ranges`, commit by commit."""
    return containment_ranges(entries, head).select("path", F.explode(F.expr("sequence(first, stop - 1)")).alias("seq"), "fault")


def orphans(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """gone, orphan: the smallest entry left below each path that is `gone` (path) or no directory any more.

    Ancestors are unrolled and met by equality, never by prefix.
    """
    below = entries.select(F.col("path").alias("orphan"), F.explode(paths.ancestors("path")).alias("path")).where("orphan <> path")
    return below.join(gone.select("path").distinct(), "path").groupBy(F.col("path").alias("gone")).agg(F.min("orphan").alias("orphan"))


def reachable(entries: DataFrame, extents: DataFrame, parts: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Versions that entries name, and chunks that those versions' extents use, each once; in so many parts by version and chunk."""
    versions = dealt(entries.select("version"), parts, "version").distinct()
    return versions, chunks_of(versions, extents, parts).distinct()


def chunks_of(versions: DataFrame, extents: DataFrame, parts: int | None = None) -> DataFrame:
    """chunk_id of the extents of versions, as often as they use it."""
    rows = dealt(extents.where("chunk_id is not null").select("version", "chunk_id"), parts, "version")
    return dealt(rows.join(versions, "version", "left_semi").select("chunk_id"), parts, "chunk_id")


def closure_faults(entries: DataFrame, versions: DataFrame, extents: DataFrame, chunks: DataFrame, parts: int | None = None) -> DataFrame:
    """missing, key: versions that entries name and chunks that their extents use, but the catalog does not hold.

    Chunks that are used and chunks that are held meet in one aggregation; `parts` as in `dealt`.
    """
    named = dealt(entries.where("version is not null").select("version"), parts, "version").distinct()
    lost = named.join(dealt(versions.select("version"), parts, "version"), "version", "left_anti")
    both = chunks_of(named, extents, parts).withColumn("held", F.lit(False)).unionByName(dealt(chunks.select("chunk_id"), parts, "chunk_id").withColumn("held", F.lit(True)))
    gone = both.groupBy("chunk_id").agg(F.max("held").alias("held")).where("not held")
    tell = lambda rows, missing, key: rows.select(F.lit(missing).alias("missing"), F.col(key).cast("string").alias("key"))
    return tell(lost, "version", "version").unionByName(tell(gone, "chunk", "chunk_id"))


def expanded(ops: DataFrame, before: DataFrame) -> DataFrame:
    """seq, op_seq, op, path, version: renames (op 'rename', path, target) become a delete and a put of the
    version that the source has in the snapshot before the transaction; other operations stay."""
    renames = ops.where("op = 'rename'").join(before.select("path", F.col("version").alias("held")), "path", "left")
    delete = renames.select("seq", "op_seq", F.lit(0).alias("half"), F.lit("delete").alias("op"), "path", F.lit(None).cast("long").alias("version"))
    put = renames.select("seq", "op_seq", F.lit(1).alias("half"), F.lit("put").alias("op"), F.col("target").alias("path"), F.col("held").alias("version"))
    plain = ops.where("op <> 'rename'").select("seq", "op_seq", F.lit(0).alias("half"), "op", "path", "version")
    order = Window.partitionBy("seq").orderBy("op_seq", "half")
    rows = plain.unionByName(delete).unionByName(put)
    return rows.withColumn("op_seq", (F.row_number().over(order) - 1).cast("long")).drop("half")
