"""Places in a total order without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import checkpointed


#: Rows up to which a table is broadcast.
BROADCAST_ROWS = 100_000


def spread(df: DataFrame) -> DataFrame:
    """df dealt to as many tasks as the session shuffles to, if its scan has fewer: for narrow rows that a costly expression is taken of."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def bounded_broadcast(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows; beyond that the join is left to the optimizer."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def global_index(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with a gapless number from 0 in this order.

    Rows are range-partitioned and sorted; a partition's first number is the sum of the sizes before it, a table with a row
    for each partition. The order's columns must tell rows apart for the numbers to be the same every time.
    """
    # Range bounds are sampled anew each time, so rows and partition sizes must come from one and the same sort.
    placed = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_row", F.monotonically_increasing_id())
    placed = placed.withColumn("_part", F.shiftright("_row", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    local = F.col("_row") - F.shiftleft("_part", 33)
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + local).drop("_row", "_part", "_start")


def best_per(df: DataFrame, group: list[str], metric: str, order: str) -> DataFrame:
    """The row with the greatest metric of each group, the first in order of equals; rows without metric come last."""
    place = F.struct(F.col(metric).isNull(), -F.col(metric), F.col(order))
    return df.groupBy(*group).agg(F.min_by(F.struct(*df.columns), place).alias("_best")).select("_best.*")


def within_group(df: DataFrame, group: str, order: list[Column], name: str) -> DataFrame:
    """df with a number from 0 in this order within each group: a group may hold any share of the rows, as places are global ones less the group's first."""
    placed = global_index(df, [F.col(group), *order], "_place")
    first = placed.groupBy(group).agg(F.min("_place").alias("_first"))
    return placed.join(bounded_broadcast(first), group).withColumn(name, F.col("_place") - F.col("_first")).drop("_place", "_first")


def pairs(many: DataFrame, few: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """All pairs of a table and a stated query set or library. few is broadcast if it has at most so many rows.

    Beyond that both are cut into blocks of about that many rows, every block of one meets every block of the other in a join on
    their numbers, and no task holds more than two blocks.
    """
    size = few.limit(rows + 1).count()
    if size <= rows:
        return many.crossJoin(F.broadcast(few))
    across, down = (-(-df.count() // rows) for df in (few, many))
    block = lambda n: F.floor(F.rand(17) * n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = many.withColumn("_d", block(down)).withColumn("_a", each(across))
    right = few.withColumn("_a", block(across)).withColumn("_d", each(down))
    return left.join(right.hint("merge"), ["_a", "_d"]).drop("_a", "_d")
