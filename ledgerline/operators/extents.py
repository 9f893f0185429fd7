"""Extents of file versions: first defects, read plans, holes, reassembly, and the ranges of stored objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def defects(extents: DataFrame, versions: DataFrame, ordinal: str, chunks: DataFrame | None = None) -> DataFrame:
    """version, defect: the first defect in list order, or else a length that does not add up.

    `ordinal` names the recorded number, which must be the place in the list (column ordinal orders it).
    With `chunks` (chunk_id, decoded_len) an extent must name a known chunk and lie within it. Sums that
    overflow are a defect, never an error.
    """
    if chunks is not None:
        extents = extents.join(chunks.select("chunk_id", F.col("decoded_len").alias("_decoded")), "chunk_id", "left")
    order = Window.partitionBy("version").orderBy("ordinal")
    end = F.expr("try_add(logical_offset, length)")
    judged = extents.withColumn("_end", end).withColumns({"_place": F.row_number().over(order) - 1, "_reached": F.coalesce(F.lag("_end").over(order), F.lit(0))})
    defect = (
        F.when(F.col(ordinal) != F.col("_place"), "ordinal_sequence")
        .when(F.col("length") <= 0, "empty")
        .when(F.col("logical_offset") > F.col("_reached"), "gap")
        .when(F.col("logical_offset") < F.col("_reached"), "overlap")
        .when(F.col("_end").isNull(), "overflow")
    )
    if chunks is not None:
        named = F.col("chunk_id").isNotNull()
        read_end = F.expr("try_add(chunk_offset, length)")
        defect = defect.when(named & F.col("_decoded").isNull(), "unknown_chunk").when(named & read_end.isNull(), "overflow").when(named & (read_end > F.col("_decoded")), "out_of_range")
    judged = judged.withColumn("defect", defect)
    first = judged.groupBy("version").agg(F.expr("min_by(defect, ordinal) filter (where defect is not null)").alias("defect"), F.max("_end").alias("covered"))
    both = versions.join(first, "version", "left")
    found = F.coalesce("defect", F.when(F.coalesce("covered", F.lit(0)) != F.col("logical_len"), "length_mismatch"))
    return both.select("version", found.alias("defect")).where("defect is not null")


def loads(extents: DataFrame) -> DataFrame:
    """version, extents, loads: a chunk stays loaded, across holes too, until another one is read."""
    before = Window.partitionBy("version").orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    held = F.last("chunk_id", ignorenulls=True).over(before)
    fresh = (F.col("chunk_id").isNotNull() & ~F.col("chunk_id").eqNullSafe(held)).cast("long")
    return extents.withColumn("fresh", fresh).groupBy("version").agg(F.count("*").alias("extents"), F.sum("fresh").alias("loads"))


def read_slices(extents: DataFrame) -> DataFrame:
    """version, slices: in order, what a version reads: chunk, its stretch, and where that goes; holes have no chunk."""
    stop = F.expr("try_add(coalesce(chunk_offset, 0L), length)").alias("chunk_stop")
    own = F.struct("ordinal", "logical_offset", "length", "chunk_id", F.when(F.col("chunk_id").isNotNull(), F.col("chunk_offset")).alias("chunk_start"), F.when(F.col("chunk_id").isNotNull(), stop).alias("chunk_stop"))
    return extents.groupBy("version").agg(F.sort_array(F.collect_list(own)).alias("slices"))


def reassembled(pieces: DataFrame) -> DataFrame:
    """doc_id, n_pieces, content_hash of the pieces put together in order; a piece that is null is a hole of
    `length` zero characters."""
    piece = F.coalesce("piece", F.expr("repeat(char(0), cast(length as int))")) if "length" in pieces.columns else F.col("piece")
    parts = pieces.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", piece.alias("piece")))).alias("parts"))
    whole = F.array_join(F.transform("parts", lambda p: p["piece"]), "")
    parts = parts.withColumn("_whole", whole)
    return parts.select("doc_id", F.size("parts").cast("long").alias("n_pieces"), F.char_length("_whole").cast("long").alias("n_chars"), F.sha2("_whole", 256).alias("content_hash"))


def restored(pieces: DataFrame, recorded: DataFrame) -> DataFrame:
    """doc_id, outcome of reading every recorded (doc_id, logical_len, content_hash) back: the extents must
    cover the length, then the content must have the hash."""
    got = reassembled(pieces).select("doc_id", "n_chars", F.col("content_hash").alias("found_hash"))
    length = F.coalesce("n_chars", F.lit(0))
    outcome = F.when(length != F.col("logical_len"), "EXTENT_INVALID").when(~F.coalesce("found_hash", F.sha2(F.lit(""), 256)).eqNullSafe(F.col("content_hash")), "CONTENT_INTEGRITY_FAILED").otherwise("ok")
    return recorded.join(got, "doc_id", "left").select("doc_id", outcome.alias("outcome"))


def object_ranges(objects: DataFrame, locations: DataFrame, frames: DataFrame, dependencies: DataFrame, commit_offset: int) -> DataFrame:
    """object_id, fault (null: sound): each object must have a location, end before the head's commit frame,
    be exactly one data frame of its recorded length, and depend on known objects only."""
    lost = dependencies.join(objects.select(F.col("object_id").alias("dependency_id")), "dependency_id", "left_anti").select("object_id").distinct().withColumn("_lost", F.lit(True))
    rows = objects.join(locations, "object_id", "left").join(frames.select(F.col("offset").alias("stored_offset"), F.col("len").alias("_len"), F.col("kind").alias("_kind")), "stored_offset", "left").join(lost, "object_id", "left")
    end = F.expr("try_add(stored_offset, stored_len)")
    fault = (
        F.when(F.col("stored_offset").isNull(), "no_location")
        .when(end.isNull(), "overflow")
        .when(end > commit_offset, "beyond_commit")
        .when(F.col("_kind").isNull(), "no_frame")
        .when((F.col("_kind") != "data") | (F.col("_len") != F.col("stored_len")), "other_frame")
        .when(F.col("_lost"), "unknown_dependency")
    )
    return rows.select("object_id", "stored_len", fault.alias("fault"))


def coverage(ranges: DataFrame) -> DataFrame:
    """expected_objects, expected_bytes, checked_objects, checked_bytes of `object_ranges`: only sound ones were read."""
    sound = F.col("fault").isNull()
    return ranges.agg(
        F.count("*").alias("expected_objects"),
        F.coalesce(F.sum("stored_len"), F.lit(0)).alias("expected_bytes"),
        F.count_if(sound).alias("checked_objects"),
        F.coalesce(F.sum(F.when(sound, F.col("stored_len"))), F.lit(0)).alias("checked_bytes"),
    )
