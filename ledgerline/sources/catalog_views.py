"""The catalog's relations as deterministic views over the star-schema tables.

A day of `events` is a commit, an event an operation on a path of its user; orders are file versions,
their lines extents over chunks; texts in pieces are content. Every ordering ends in a unique key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Texts are cut into pieces of so many characters.
PIECE = 512


class Tables:
    """The Parquet tables of a folder, read lazily with only the columns that a plan uses."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


FIRST_DAY = "2024-01-01"


def keyed_ops(t: Tables, upto: int | None = None) -> DataFrame:
    """seq, op_seq, op, path, version, user_id: the operations as they came, faults included. op_seq orders the
    operations of a commit but does not number them, so that no commit has to be in one task.

    `upto` bounds the commits by the time of their events, which reaches the scan.
    """
    events = t.events
    if upto is not None:
        events = events.where(F.col("ts") < F.date_add(F.lit(FIRST_DAY).cast("date"), upto + 1).cast("timestamp_ntz" if events.schema["ts"].dataType.typeName() == "timestamp_ntz" else "timestamp"))
    return events.select(
        F.datediff(F.to_date("ts"), F.lit(FIRST_DAY)).cast("long").alias("seq"),
        F.struct("ts", "event_id").alias("op_seq"),
        F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), F.get_json_object("props", "$.k")).alias("path"),
        F.col("event_id").alias("version"),
        "user_id",
    )


def raw_ops(t: Tables) -> DataFrame:
    """The operations of `keyed_ops` with their numbers in the commit as op_seq."""
    order = Window.partitionBy("seq").orderBy("op_seq")
    return keyed_ops(t).withColumn("op_seq", (F.row_number().over(order) - 1).cast("long"))


def commits(t: Tables) -> DataFrame:
    """seq, parent_seq of every commit that has operations."""
    seqs = t.events.select(F.datediff(F.to_date("ts"), F.lit(FIRST_DAY)).cast("long").alias("seq")).distinct()
    return seqs.withColumn("parent_seq", F.when(F.col("seq") > 0, F.col("seq") - 1))


def head(t: Tables) -> int:
    """The number of the newest commit."""
    return t.events.agg(F.datediff(F.to_date(F.max("ts")), F.lit(FIRST_DAY))).first()[0]


def extent_refs(t: Tables) -> DataFrame:
    """version, chunk_id, length of every extent, without their order."""
    return t.lineitem.select(F.col("l_orderkey").alias("version"), (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("chunk_id"), F.col("l_quantity").cast("long").alias("length"))


def file_versions(t: Tables) -> DataFrame:
    """version, logical_len: an order's lines make its length."""
    return t.lineitem.groupBy(F.col("l_orderkey").alias("version")).agg(F.sum(F.col("l_quantity").cast("long")).alias("logical_len"))


def extents(t: Tables) -> DataFrame:
    """version, ordinal, raw_ordinal, logical_offset, length, chunk_id: contiguous by their ordinal."""
    lines = t.lineitem.select(
        F.col("l_orderkey").alias("version"),
        F.col("l_linenumber").cast("long").alias("raw_ordinal"),
        "l_partkey",
        "l_suppkey",
        F.col("l_quantity").cast("long").alias("length"),
        "l_extendedprice",
        (F.col("l_partkey") * 100000 + F.col("l_suppkey")).alias("chunk_id"),
    )
    order = Window.partitionBy("version").orderBy("raw_ordinal", "l_partkey", "l_suppkey", "length", "l_extendedprice")
    lines = lines.withColumn("ordinal", (F.row_number().over(order) - 1).cast("long"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    lines = lines.withColumn("logical_offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))
    return lines.select("version", "ordinal", "raw_ordinal", "logical_offset", "length", "chunk_id")


def pieces(t: Tables) -> DataFrame:
    """doc_id, ordinal, piece, content_hash: fixed-size chunks of texts; an empty text has none."""
    docs = t.documents.where("length(text) > 0").select("doc_id", "text")
    at = docs.withColumn("ordinal", F.explode(F.expr(f"sequence(0L, cast((length(text) - 1) div {PIECE} as bigint))")))
    cut = at.withColumn("piece", F.expr(f"substring(text, cast(ordinal * {PIECE} + 1 as int), {PIECE})"))
    return cut.select("doc_id", "ordinal", "piece", F.sha2("piece", 256).alias("content_hash"))


def evidence(t: Tables) -> DataFrame:
    """event_id, seq, completed, dimension, kind, status of health records."""
    return t.events.select(
        "event_id",
        F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long").alias("seq"),
        F.unix_timestamp("ts").alias("completed"),
        F.when(F.col("event_type") == "purchase", "restore_test").otherwise("verify").alias("kind"),
        F.element_at(F.array(*map(F.lit, ("integrity", "recoverability", "durability"))), (F.col("user_id") % 3 + 1).cast("int")).alias("dimension"),
        F.when(F.col("event_type") == "error", "FAIL").when(F.col("value") < 20, "DEGRADED").when(F.col("value") < 30, "UNKNOWN").otherwise("PASS").alias("status"),
    )
