"""Rendered output: JSON lines with binaries told apart from text, and the evidence log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import text

EVIDENCE = "event_id long, seq long, completed long, dimension string, kind string, status string"


def rendered(table: DataFrame) -> DataFrame:
    """json of every row; binaries are objects with hexadecimal digits."""

    def one(name: str, kind: str) -> Column:
        return text.typed(name, "binary").alias(name) if kind == "binary" else F.col(name)

    return table.select(F.to_json(F.struct(*[one(n, k) for n, k in table.dtypes]), {"ignoreNullFields": "false"}).alias("json"))


def write_json(table: DataFrame, path: str) -> None:
    rendered(table).select(F.col("json").alias("value")).write.mode("overwrite").text(path)


def append_evidence(records: DataFrame, path: str) -> None:
    """Add records to a log, a line each. Every append writes files of its own, so a torn line of an earlier
    one never runs into these."""
    records.select(*[c.split()[0] for c in EVIDENCE.split(", ")]).write.mode("append").json(path)
