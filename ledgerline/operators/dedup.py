"""Content dedup: an index of the pieces that are stored, and what new content finds in it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def index(pieces: DataFrame) -> DataFrame:
    """decoded_len, content_hash, object_id: the smallest object of each content."""
    return pieces.groupBy(F.length("piece").cast("long").alias("decoded_len"), "content_hash").agg(F.min("object_id").alias("object_id"))


def usable(chunks: DataFrame, reachable: DataFrame, locations: DataFrame, dependencies: DataFrame) -> DataFrame:
    """The chunks (object_id) that new content may reuse: used at the head, stored somewhere, depending on nothing."""
    rows = chunks.join(reachable.select("object_id").distinct(), "object_id", "left_semi").join(locations.select("object_id"), "object_id", "left_semi")
    return rows.join(dependencies.select("object_id").distinct(), "object_id", "left_anti")


def mode(asked: str, streams: bool) -> str:
    """Whether an archive reuses chunks: 'in_archive' or 'off'. One that is also a plain stream never does."""
    if asked == "in_archive" and streams:
        raise ValueError("an archive that is a plain stream cannot reuse chunks")
    return {"auto": "off" if streams else "in_archive", "in_archive": "in_archive", "off": "off"}[asked]


def probed(new: DataFrame, stored: DataFrame) -> DataFrame:
    """New pieces with the object whose bytes equal theirs; null where none has them. Pieces that come
    together are not compared with each other."""
    found = index(stored).join(stored.select("object_id", F.col("piece").alias("kept")), "object_id")
    rows = new.withColumn("decoded_len", F.length("piece").cast("long")).join(found, ["decoded_len", "content_hash"], "left")
    return rows.withColumns({"reused": F.col("piece").eqNullSafe(F.col("kept")), "rejected": F.col("kept").isNotNull() & (F.col("piece") != F.col("kept"))}).drop("kept")


def statistics(probes: DataFrame) -> DataFrame:
    """chunks, chunks_reused, bytes_reused, candidates_rejected."""
    return probes.agg(
        F.count("*").alias("chunks"),
        F.count_if("reused").alias("chunks_reused"),
        F.coalesce(F.sum(F.when(F.col("reused"), F.col("decoded_len"))), F.lit(0)).alias("bytes_reused"),
        F.count_if("rejected").alias("candidates_rejected"),
    )
