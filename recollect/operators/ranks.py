"""Ranks over a whole table without a window in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from recollect.sources import staging


def numbered(df: DataFrame, *order: str, name: str = "k") -> DataFrame:
    """`df` with the place of each row in the order, from 1. Rows are sorted by ranges; a place is the place in its range and the rows of
    the ranges before, of which there are as many as tasks."""
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = staging.staged(placed, "ordered").withColumn("_part", F.shiftright("_at", 33))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a task
    ahead = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_ahead"))
    place = F.col("_ahead") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(ahead), "_part").withColumn(name, place).drop("_part", "_at", "_ahead")


def within(df: DataFrame, groups: list[str], *order: str, total: str | None = None, name: str = "k") -> DataFrame:
    """`df` with the place of each row in its group, from 1, the group's size `n_group`, and with `total` the sum of that column up to and with the row (`upto`).
    Rows are sorted once by ranges of group and order, so a group of any size is spread over tasks; what stands before a range is added up
    from a row a group and task."""
    placed = df.repartitionByRange(*groups, *order).sortWithinPartitions(*groups, *order).withColumn("_at", F.monotonically_increasing_id())
    rows = staging.staged(placed, "in-groups").withColumn("_part", F.shiftright("_at", 33))
    sums = [F.sum(total).alias("_s")] if total else []
    parts = rows.groupBy(*groups, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"), *sums)
    w, every = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*groups)  # as many rows as tasks
    ahead = parts.select(*(F.col(c).alias(f"_g{i}") for i, c in enumerate(groups)), F.col("_part").alias("_p"), "_first", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_ahead"), F.sum("_n").over(every).alias("n_group"), *([F.coalesce(F.sum("_s").over(w), F.lit(0)).alias("_before")] if total else []))
    same = F.col("_part") == F.col("_p")
    for i, c in enumerate(groups):
        same &= F.col(c).eqNullSafe(F.col(f"_g{i}"))
    out = rows.join(ahead, same)
    if total:
        here = Window.partitionBy(*groups, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)  # a task's rows
        out = out.withColumn("upto", F.col("_before") + F.coalesce(F.sum(total).over(here), F.lit(0)))
    return out.withColumn(name, F.col("_ahead") + F.col("_at") - F.col("_first") + 1).select(*df.columns, name, "n_group", *(["upto"] if total else []))
