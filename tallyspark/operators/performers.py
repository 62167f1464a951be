"""Revenue rankings of SKUs, regions and channels, current period against the one before."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_start, shift_month
from ..sources.schema import UNKNOWN
from ..spark_tools import small_rows
from .ranking import top_k
from .scoping import DateRange, by_columns, month_span, previous_month, previous_span, real_dimension


def _totals(rows: DataFrame, dim: str, by: tuple[str, ...], is_current: Column, is_previous: Column) -> DataFrame:
    current = F.coalesce(F.sum(F.when(is_current, F.col("revenue"))), F.lit(0)).cast("double")
    before = F.coalesce(F.sum(F.when(is_previous, F.col("revenue"))), F.lit(0)).cast("double")
    totals = rows.groupBy(*by, F.col(dim).alias("dimension_value")).agg(current.alias("current"), before.alias("_before"))
    previous = F.when(F.col("_before") > 0, F.col("_before"))
    return totals.select(*by, "dimension_value", "current", previous.alias("previous"),
                         ((F.col("current") - previous) / previous).alias("delta_pct"))


def _prepared(sales: DataFrame, dim: str, by: tuple[str, ...]) -> DataFrame:
    rows = sales.filter(real_dimension(F.col(dim)) & F.col("date").isNotNull())
    return rows.select(*by_columns(rows, by), *[F.col(c) for c in {dim, "date", "revenue"} - set(by)])


def performers_in_range(sales: DataFrame, dim: str, span: DateRange, by: tuple[str, ...] = (),
                        before: DateRange | None = None) -> DataFrame:
    """Totals of two adjacent ranges; only rows inside them are read."""
    before = before or previous_span(span)
    rows = _prepared(sales, dim, by).filter(F.col("date").between(F.lit(before[0]), F.lit(span[1])))
    is_current = F.col("date") >= F.lit(span[0])
    return _totals(rows, dim, by, is_current, F.col("date").between(F.lit(before[0]), F.lit(before[1])))


def performers_in_month(sales: DataFrame, dim: str, month: dt.date, by: tuple[str, ...] = ()) -> DataFrame:
    span = month_span(month)
    return performers_in_range(sales, dim, span, by, month_span(previous_month(span[0])))


def performers_latest_month(sales: DataFrame, dim: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Every scope against its own latest month."""
    if not by:
        last = sales.agg(F.max("date")).first()[0]
        return performers_in_month(sales, dim, last or dt.date(1970, 1, 1))
    # the anchors are one row per scope: few enough, they are broadcast and the earliest of them bounds the scan; too
    # many, and they are joined by shuffle like any other table
    anchors = sales.groupBy(*by_columns(sales, by)).agg(month_start(F.max("date")).alias("_anchor"))
    known = small_rows(anchors)
    if known is not None:
        anchors = F.broadcast(sales.sparkSession.createDataFrame(known, anchors.schema))
        months = [m for m in known.column("_anchor").to_pylist() if m]
        sales = sales.filter(F.col("date") >= F.lit(previous_month(min(months)) if months else dt.date.max))
    rows = _prepared(sales, dim, by).join(anchors, list(by))
    month = month_start(F.col("date"))
    previous = shift_month(F.col("_anchor"), -1)
    rows = rows.filter(F.col("date") >= previous)
    return _totals(rows, dim, by, month == F.col("_anchor"), month == previous)


def ranked_performers(performers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return performers.orderBy(*by, F.col("current").desc(), "dimension_value")


def best_order() -> list[Column]:
    return [F.col("current").desc(), F.col("dimension_value").asc()]


def worst_order() -> list[Column]:
    return [F.col("current").asc(), F.col("dimension_value").desc()]


def top_bottom(performers: DataFrame, k: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """First and last ``k`` of the ranking; they overlap when there are fewer than ``2k``."""
    top = top_k(performers, k, best_order(), by).withColumn("side", F.lit("top"))
    bottom = top_k(performers, k, worst_order(), by).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom)


def category_cut(categories: DataFrame, k: int = 6, by: tuple[str, ...] = ()) -> DataFrame:
    """The ``k`` largest categories of a breakdown, overall or (with fewer, as charts stand side by side) per currency."""
    return top_k(categories, k, best_order(), by)


def available_channels(sales: DataFrame, orders: DataFrame | None) -> DataFrame:
    names = sales.select("channel")
    if orders is not None:
        names = names.union(orders.select("channel"))
    return names.filter(F.col("channel").isNotNull() & (F.col("channel") != "") & (F.col("channel") != UNKNOWN)
                        ).distinct().orderBy("channel")
