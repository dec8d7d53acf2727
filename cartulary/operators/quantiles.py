"""Exact quantiles of a whole table, from counts of its values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartulary.operators.prefix import running
from cartulary.operators.stored import stored


def of_counts(counts: DataFrame, shares: dict[str, float]) -> DataFrame:
    """One row with a column for each of ``shares``: that quantile of the values in ``counts`` (value, n), each value
    once, interpolated linearly between the two ranks next to it. Null where there is no value; nulls do not count.

    The values' counts are summed up by ranges of the values, and a quantile's two ranks are looked up in the sums:
    nothing is sorted in one task, and only one row for each range meets in one.
    """
    ranked = running(counts.where("value is not null"), ["value"], {"_before": F.col("n")}, stored)
    total = ranked.agg(F.sum("n").alias("_total"))
    spots = {name: F.lit(float(share)) * (F.col("_total") - 1) for name, share in shares.items()}
    held = lambda rank: F.max(F.when((F.col("_before") <= rank) & (rank < F.col("_before") + F.col("n")), F.col("value")))
    found = ranked.crossJoin(F.broadcast(total)).agg(  # one row
        F.max("_total").alias("_total"), *[held(f(spot)).alias(f"_{k}_{name}") for name, spot in spots.items() for k, f in (("low", F.floor), ("high", F.ceil))]
    )
    between = lambda name, spot: (F.ceil(spot) - spot) * F.col(f"_low_{name}") + (spot - F.floor(spot)) * F.col(f"_high_{name}")
    return found.select(*[F.when(F.col(f"_low_{name}") == F.col(f"_high_{name}"), F.col(f"_low_{name}").cast("double")).otherwise(between(name, spot)).alias(name) for name, spot in spots.items()])


def quantiles(df: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """``of_counts`` of a column: equal values are counted before anything is shuffled."""
    return of_counts(df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")), shares)
