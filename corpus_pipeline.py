"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last keep the columns of
`documents`. Between stages the table is written and read again, so a lost executor costs no more
than the stage it was lost in.

Every stage takes further columns of any names and hands them on as they are; n_chars, where it is there,
follows a changed text. An empty table gives an empty table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.llm import jaccard_join, packing, quality_rules, secret_scan, suffix_dedup
from ledgerline.llm.common import drop_stored, stored, table


def _resized(docs: DataFrame) -> DataFrame:
    """n_chars as the text now has it, where the table has such a column."""
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules and are in the language that they say.

    A null or empty text goes; a null language is judged by the whole corpus; repeated rows share a verdict;
    equally frequent words of a reference go by their bytes.
    """
    return quality_rules.kept_rows(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of similar texts, the document of the smallest id; of equal rows, one.

    A null or empty text is like nothing and stays, and so does a row without an id; rows of one id with
    different texts stay together. Texts are told apart by their SHA-256.
    """
    found = jaccard_join.classes(docs, n=5, num=80)
    first = found.where("doc_id = component_id").select(F.col("doc_id").alias("_id")).distinct()
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    rows = docs.select(whole, F.col("doc_id").cast("long").alias("_id"), F.sha2(F.col("text").cast("string"), 256).alias("_hash"))
    kept = rows.join(first, "_id", "left_semi").dropDuplicates(["_id", "_hash"]).select("_row")
    kept = kept.unionByName(rows.where("_id is null").select("_row"))
    return kept.select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the stretches of 200 bytes or more that occur again anywhere.

    A null text stays null and an empty one empty; a repeated row is another occurrence, so both lose their
    text; overlapping stretches go together; shorter texts stay as they are.
    """
    return _resized(suffix_dedup.remove(docs, length=200))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a mark in place of each secret.

    A null text stays null and an empty one empty; overlapping secrets get one mark; repeated rows are masked
    alike; no row goes.
    """
    return _resized(secret_scan.mask(docs, secret_scan.fit(docs)))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 4096 tokens.

    A null or empty text is its end id alone; equal scores go by id and text; repeated rows are packed once
    each; further columns are not read.
    """
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


STAGES = [
    ("quality rules", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("secret scans", secrets),
    ("packing", packed),
]

#: No SQL: suffix arrays, character models and tokenizers are beyond it; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after another, over `documents`."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
        drop_stored(*before)  # what the next stage no longer reads
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
