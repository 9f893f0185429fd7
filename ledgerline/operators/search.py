"""Search over one or many snapshots, with a proof of what was searched; lookups and dumps of relations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions import paths

from .timeline import in_snapshots


@dataclass
class Query:
    """What must all hold of an entry; nothing set lists every entry."""

    path: str | None = None
    under: str | None = None
    text: str | None = None
    fold: bool = False
    kind: str | None = None
    version: int | None = None
    content_hash: str | None = None

    def of_entry(self) -> Column:
        """What the entry alone tells, so that few entries meet their versions."""
        out = F.lit(True)
        if self.path is not None:
            out &= F.col("path") == self.path
        if self.under is not None:
            out &= paths.within("path", self.under)
        if self.text is not None:
            out &= paths.has("path", self.text, self.fold)
        if self.version is not None:
            out &= F.col("version") == self.version
        return out

    def of_version(self) -> Column:
        out = F.lit(True)
        if self.kind is not None:
            out &= F.col("kind") == self.kind
        if self.content_hash is not None:
            out &= F.col("content_hash") == self.content_hash
        return out


def search(entries: DataFrame, versions: DataFrame, query: Query) -> DataFrame:
    """The entries that a query finds, with what their versions (version, kind, content_hash, ...) tell."""
    return entries.where(query.of_entry()).join(versions.where(query.of_version()), "version")


def listing(entries: DataFrame, versions: DataFrame, under: str | None = None) -> DataFrame:
    """path, kind, logical_len, content_hash at or below a path, by path."""
    return search(entries, versions, Query(under=under)).select("path", "kind", "logical_len", "content_hash").orderBy("path")


def over_snapshots(entries: DataFrame, head: int, wanted: DataFrame, held: DataFrame, hit: Column) -> tuple[DataFrame, DataFrame]:
    """Hits by commit and path over the wanted snapshots, and one row of coverage: how many were asked for and
    searched, which the catalog does not hold, and how many entries were looked at."""
    searched = wanted.join(held.select("seq"), "seq", "left_semi")
    rows = in_snapshots(entries, head, searched)
    asked = wanted.join(held.select("seq").withColumn("_held", F.lit(True)), "seq", "left")
    sums = asked.agg(F.count("*").alias("requested"), F.count("_held").alias("searched"), F.sort_array(F.collect_set(F.when(F.col("_held").isNull(), F.col("seq")))).alias("unavailable"))
    return rows.where(hit).orderBy("seq", "path"), sums.crossJoin(rows.agg(F.count("*").alias("entries_examined")))


def with_dependencies(objects: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Objects with the sorted list of what they depend on; empty where on nothing."""
    lists = dependencies.groupBy("object_id").agg(F.sort_array(F.collect_set("dependency_id")).alias("dependencies"))
    return objects.join(lists, "object_id", "left").withColumn("dependencies", F.coalesce("dependencies", F.array().cast(lists.schema["dependencies"].dataType)))


def dump(table: DataFrame) -> DataFrame:
    """All rows of a relation, by every column in its position."""
    return table.orderBy(*table.columns)
