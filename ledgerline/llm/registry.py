"""The registered corpus queries and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, fingerprints, html_text, huffman, jaccard_join, oracles, packing, quality_rules, secret_scan, suffix_dedup, toxicity
from .common import scratch, table


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), window=4096, end_id=2)


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), length=200)


def op4_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op6_jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(table(spark, sf_dir, "documents"), n=3, num=90)


def op7_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    scored = toxicity.score(docs, toxicity.fit(*toxicity.sample(docs, labels, fold != 2)))
    return scored.select("doc_id", (fold == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_huffman_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-file")
    huffman.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return huffman.read(spark, path)


def op9_bottom_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_likeness(table(spark, sf_dir, "documents"))


def op10_markov_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.fit(docs))


def queries() -> dict:
    return {
        "op1_retrieval_packing": op1_retrieval_packing,
        "op2_site_style_tree": op2_site_style_tree,
        "op3_suffix_dedup": op3_suffix_dedup,
        "op4_divergence_rules": op4_divergence_rules,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_jaccard_tiles": op6_jaccard_tiles,
        "op7_crf_toxicity": op7_crf_toxicity,
        "op8_huffman_ids": op8_huffman_ids,
        "op9_bottom_k": op9_bottom_k,
        "op10_markov_secrets": op10_markov_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_divergence_rules": oracles.OP4, "op6_jaccard_tiles": oracles.OP6}
