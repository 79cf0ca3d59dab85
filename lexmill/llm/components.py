"""Connected components by alternating large-star and small-star rounds; only checkpointed tables, nothing on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, lookup


def _with_least(rows: DataFrame, name: str) -> DataFrame:
    """rows (a, b) with the least b of each a. A node that many rows have is looked up in a bounded broadcast, not dealt to one task."""
    least = checkpoint(rows.groupBy("a").agg(F.min("b").alias(name), F.count("*").alias("n")))
    return lookup(rows, least, "a", "n", least.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return _with_least(both, "m").filter("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
    moved = _with_least(down, "m")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(moved.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of comparable ids without nulls; returns (node, root) for every node of an edge between two nodes.

    root is the least node of the component. Rounds go on until the edges stay the same.
    """
    current, seen = checkpoint(edges.filter("a <> b").distinct()), None
    while True:
        mark = current.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        current = checkpoint(_small_star(_large_star(current).distinct()).filter("a <> b").distinct())
    return current.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
