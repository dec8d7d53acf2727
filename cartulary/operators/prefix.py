"""Sums over all rows before a row in a total order, without bringing the rows into one task."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running(df: DataFrame, order: list[str], sums: dict[str, Column], save: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``df`` with a column for each of ``sums``: its sum over the rows that come before in ``order`` (0 for the first).

    Rows are parted by ranges of ``order``, whose values should be distinct: ties are put in any order. ``save`` writes
    a frame and reads it back, so that a range keeps its rows when an executor is lost. Only one row for each range
    meets in a task, whatever the table's size. Nulls come first; a null summand counts as 0.
    """
    ranged = save(df.withColumns({f"_{k}": F.coalesce(v, F.lit(0)) for k, v in sums.items()}).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(*[F.sum(f"_{k}").alias(f"_{k}") for k in sums])
    starts = totals.select("_range", *[F.coalesce(F.sum(f"_{k}").over(before), F.lit(0)).alias(f"_from_{k}") for k in sums])
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({k: F.coalesce(F.sum(f"_{k}").over(inside), F.lit(0)) for k in sums})
    added = placed.join(F.broadcast(starts), "_range").withColumns({k: F.col(k) + F.col(f"_from_{k}") for k in sums})  # a row a range
    return added.drop("_range", *[f"_{k}" for k in sums], *[f"_from_{k}" for k in sums])
