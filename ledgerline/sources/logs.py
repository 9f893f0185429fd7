"""Sources beside the catalog: the evidence log, last-seen heads, and trees of files to import."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions import paths
from ledgerline.sinks.output import EVIDENCE


def read_evidence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The records of a log, and one row with how many lines could not be read (unreadable); a bad line is
    counted, never fatal. A record without its commit, time or status is none."""
    lines = spark.read.schema(f"{EVIDENCE}, broken string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "broken").json(path)
    whole = F.col("broken").isNull() & F.col("seq").isNotNull() & F.col("completed").isNotNull() & F.col("status").isNotNull()
    return lines.where(whole).drop("broken"), lines.agg(F.count_if(~whole).alias("unreadable"))


def merged_heads(known: DataFrame, seen: DataFrame) -> DataFrame:
    """archive, seq, commit_id of the newest head of each archive: what is known only advances."""
    both = known.select("archive", "seq", "commit_id", F.lit(0).alias("order")).unionByName(seen.select("archive", "seq", "commit_id", F.lit(1).alias("order")))
    newest = F.max_by(F.struct("seq", "commit_id"), F.struct("seq", -F.col("order"))).alias("r")
    return both.groupBy("archive").agg(newest).select("archive", "r.seq", "r.commit_id")


def import_scan(spark: SparkSession, folder: str, most: int | None = None) -> DataFrame:
    """path, kind, length of every file below a folder and of the directories above them, parents first and
    siblings by bytes. Links and other special files are not listed. More than `most` bytes are refused."""
    root = folder.rstrip("/").removeprefix("file://")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    files = files.select(F.expr(f"substring(path, instr(path, '{root}') + {len(root) + 1})").alias("path"), F.lit("file").alias("kind"), "length")
    if most is not None and (files.agg(F.sum("length")).first()[0] or 0) > most:
        raise ValueError(f"the tree holds more than {most} bytes")
    above = files.where(F.col("path").contains("/")).select(F.explode(paths.ancestors("path")).alias("path")).distinct()
    folders = above.select("path", F.lit("directory").alias("kind"), F.lit(0).cast("long").alias("length"))
    return files.unionByName(folders).orderBy(F.split("path", "/"))
