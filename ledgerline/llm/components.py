"""Connected components of a table of links, without gathering a component anywhere.

Alternating star operations on the links, each a grouped minimum and a join, until every node points
at the smallest node it can reach. Links that form one task's share are first reduced to a forest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NARROW_ROWS, drop_stored, stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node reached by these links) of every node that is not that smallest itself."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == label).all():
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[moved], nodes[label[moved]]


def _reduced(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = forest(batch.column("a").to_numpy(), batch.column("b").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return links.select("a", "b").mapInArrow(run, "a long, b long")


def connected(links: DataFrame, what: str = "components") -> DataFrame:
    """node, component (the smallest node reachable) for every node of a link (a, b: long) to another."""
    links = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(_reduced(links).distinct(), what, NARROW_ROWS)
    while True:
        # Large star: a node's larger neighbours move to the smallest one it knows.
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: a node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        rest = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = stored(rest.union(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct(), what)
        # Stars whose centres are no one's leaves are the components.
        again = new.join(new.select(F.col("a").alias("b")).distinct(), "b", "left_semi").limit(1).count()
        twice = 0 if again else new.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").limit(1).count()
        drop_stored(edges)
        edges = new
        if not again and not twice:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
