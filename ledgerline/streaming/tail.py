"""The head of a log that is still being written, kept up to date by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

OPS = "seq long, op_seq long, op string, path string, version long"


def ops_stream(spark: SparkSession, folder: str, files_per_trigger: int = 64) -> DataFrame:
    """Operations as Parquet files arrive in a folder; the schema is declared, never inferred."""
    return spark.readStream.schema(OPS).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def live_head(ops: DataFrame) -> DataFrame:
    """path, op, version of the last operation of every path seen; state is one row a path.

    Files may arrive in any order, since the order of operations is that of their numbers.
    """
    last = ops.groupBy("path").agg(F.max_by(F.struct("op", "version"), F.struct("seq", "op_seq")).alias("last"))
    return last.select("path", "last.op", "last.version")


def follow(ops: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Keeps the changes of the head in a folder, until what is there now has been read: each batch adds the
    paths that it changed, under its number. Nothing goes through the driver."""

    def add(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{folder}/batch={batch}")

    return live_head(ops).writeStream.outputMode("update").foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def head(spark: SparkSession, folder: str) -> DataFrame:
    """path, version of the followed head: of each path the change of the latest batch, if that is a put."""
    rows = spark.read.schema("path string, op string, version long, batch long").parquet(folder)
    last = rows.groupBy("path").agg(F.max_by(F.struct("op", "version"), "batch").alias("last"))
    return last.where("last.op = 'put'").select("path", F.col("last.version").alias("version"))
