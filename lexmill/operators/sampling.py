"""Reproducible sampling: order by a hash of seed and id, which any engine can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.operators.order import bounded_broadcast, global_index


def draw(seed: int | str, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary"))


def numbered(df: DataFrame, order: list[Column], name: str = "rn") -> DataFrame:
    """df with 0, 1, 2, … in this order, from a range-partitioned sort and the sizes of its partitions; no single task sorts all rows."""
    return global_index(df, order, name)


def shuffled(df: DataFrame, seed: int, key: Column) -> DataFrame:
    return df.orderBy(draw(seed, key), key)


def prefix_split(df: DataFrame, seed: int, key: Column, shares: list[tuple[str, float]]) -> DataFrame:
    """split names by place in hash order: each but the last takes int(n * share) rows."""
    placed = numbered(df.withColumn("_draw", draw(seed, key)), [F.col("_draw"), key], "_place")
    total = F.broadcast(df.agg(F.count("*").alias("_n")))
    split, bound = None, F.lit(0)
    for name, share in shares[:-1]:
        bound = bound + F.floor(F.col("_n") * F.lit(share))
        split = F.when(F.col("_place") < bound, name) if split is None else split.when(F.col("_place") < bound, name)
    return placed.crossJoin(total).withColumn("split", split.otherwise(shares[-1][0])).drop("_draw", "_place", "_n")


def group_split(df: DataFrame, group: str, seed: int, test_share: float) -> DataFrame:
    """Every group is wholly in train or in test: the first int(groups * (1 - share)) in hash order train."""
    groups = df.select(group).filter(F.col(group).isNotNull()).distinct()
    parts = prefix_split(groups, seed, F.col(group), [("train", 1 - test_share), ("test", 0)])
    return df.join(parts, group)


def fold(key: Column, k: int) -> Column:
    return F.pmod(F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(k))


def stratified(df: DataFrame, strata: list[str], size: int, seed: int, key: str) -> DataFrame:
    """max(1, size // strata) rows of each stratum in hash order, topped up from the others in hash order, at most size."""
    rows = df.withColumn("_draw", draw(seed, F.col(key)))
    number = rows.select(*strata).distinct().agg(F.greatest(F.lit(1), F.floor(F.lit(size) / F.greatest(F.count("*"), F.lit(1)))).alias("_k"))
    ranked = rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*strata).orderBy("_draw", key))).filter(F.col("_rn") <= size)
    first = ranked.crossJoin(F.broadcast(number)).withColumn("_later", (F.col("_rn") > F.col("_k")).cast("int"))
    return first.orderBy("_later", "_draw", key).limit(size).drop("_draw", "_rn", "_k", "_later")


def balanced(df: DataFrame, label: str, order: str) -> DataFrame:
    """The first n rows of each label in order, n being the size of the smallest; nothing is kept beyond it, whatever the log says."""
    placed = global_index(df, [F.col(label), F.col(order)], "_place")
    sizes = placed.groupBy(label).agg(F.min("_place").alias("_first"), F.count("*").alias("_size"))
    least = sizes.agg(F.min("_size").alias("_least"))
    inside = placed.join(bounded_broadcast(sizes), label).crossJoin(F.broadcast(least))
    return inside.filter(F.col("_place") - F.col("_first") < F.col("_least")).select(*df.columns)


def hash_pick(rows: DataFrame, candidates: DataFrame, row_key: str, candidate_key: str, differs: Column, seed: int) -> DataFrame:
    """For each row one candidate for which `differs` holds: the candidates are numbered once, and a row's hash names a place among them.

    If the candidate there does not differ, the next place is tried; candidates are distinct values, so one step is enough.
    Rows without any other candidate are an error, raised when they are read.
    """
    pool = numbered(candidates, [F.col(candidate_key)], "_slot")
    size = candidates.agg(F.count("*").alias("_n"))
    at = F.conv(F.substring(draw(seed, F.col(row_key)), 1, 8), 16, 10).cast("bigint")
    enough = F.when(F.col("_n") < 2, F.raise_error(F.lit("there is no other candidate to draw")).cast("bigint")).otherwise(F.col("_n"))
    placed = rows.crossJoin(F.broadcast(size)).withColumn("_n", enough).withColumn("_at", F.pmod(at, F.greatest(F.col("_n"), F.lit(1))))
    tries = placed.withColumn("_try", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_slot", F.pmod(F.col("_at") + F.col("_try"), F.greatest(F.col("_n"), F.lit(1))))
    hit = tries.join(pool, "_slot").filter(differs)
    first = Window.partitionBy(row_key).orderBy("_try")
    return hit.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_slot", "_n", "_at", "_try", "_rn")
