"""Date buckets and per-series statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.coerce import number_or_zero
from ..functions.dates import GRAIN_START
from .scoping import by_columns, count_rows, real_dimension


def bucket(df: DataFrame, date_column: str, grain: str, value: str | Column, dim: str | None = None,
           by: tuple[str, ...] = ()) -> DataFrame:
    """Sum of ``value`` and row count per period, and per dimension value when ``dim`` is given.

    Rows without a date, and placeholder dimension values, take no part. Empty periods are absent, not zero.
    """
    value = F.col(value) if isinstance(value, str) else value
    keys = by_columns(df, by)
    df = df.filter(F.col(date_column).isNotNull())
    if dim is not None:
        df = df.filter(real_dimension(F.col(dim)))
        keys.append(F.col(dim).alias("dimension_value"))
    return (
        df.groupBy(*keys, GRAIN_START[grain](F.col(date_column)).alias("start"))
        .agg(number_or_zero(F.sum(value).cast("double")).alias("value"), count_rows(df).alias("n_rows"))
    )


def _series(by: tuple[str, ...]):
    # a series holds one row per period, so its length is bounded by the calendar whatever the row count behind it;
    # ordering by period makes floating sums come out the same on every run
    return W.partitionBy(*by, "dimension_value").orderBy("start")


def spread_stats(buckets: DataFrame, by: tuple[str, ...] = (), least: int = 1) -> DataFrame:
    """Adds length, mean and population deviation of each series of at least ``least`` periods (passes over one sorted
    partition; shorter series leave after the first)."""
    whole = _series(by).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return (
        buckets.withColumn("n", F.count(F.lit(1)).over(whole)).filter(F.col("n") >= least)
        .withColumn("mean", F.sum("value").over(whole) / F.col("n"))
        .withColumn("sd", F.sqrt(
            F.sum((F.col("value") - F.col("mean")) * (F.col("value") - F.col("mean"))).over(whole) / F.col("n")))
    )


def quartile_stats(buckets: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds length and exact interpolated quartiles of each series."""
    whole = W.partitionBy(*by, "dimension_value")
    quartiles = F.percentile("value", [0.25, 0.75]).over(whole)
    return (
        buckets.withColumn("n", F.count(F.lit(1)).over(whole)).withColumn("q", quartiles)
        .withColumn("q1", F.col("q")[0]).withColumn("q3", F.col("q")[1]).drop("q")
    )


def trailing_mean(buckets: DataFrame, window: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds the mean of the previous ``window`` present periods; null until that many exist."""
    back = _series(by).rowsBetween(-window, -1)
    full = F.count(F.lit(1)).over(back) == window
    return buckets.withColumn("baseline", F.when(full, F.sum("value").over(back) / window))
