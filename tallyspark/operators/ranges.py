"""Reporting ranges anchored to the data's own last day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_start, quarter_start, shift_month
from .scoping import DateRange


def date_bounds(sales: DataFrame) -> DataFrame:
    return sales.agg(F.min("date").alias("start"), F.max("date").alias("end")).filter(F.col("end").isNotNull())


def range_presets(bounds: DataFrame) -> DataFrame:
    """The offered ranges, in menu order. A null range means calendar mode, or a range still to be entered."""
    start, end = F.col("start"), F.col("end")
    none = F.lit(None).cast("date")
    last_month = shift_month(month_start(end), -1)
    presets = [
        ("currentMonth", "Current month", none, none),
        ("allTime", "All time", start, end),
        ("last30", "Last 30 days", F.date_sub(end, 29), end),
        ("last90", "Last 90 days", F.date_sub(end, 89), end),
        ("lastMonth", "Last month", last_month, F.last_day(last_month)),
        ("thisQuarter", "This quarter", quarter_start(end), end),
        ("thisYear", "This year", F.trunc(end, "year").cast("date"), end),
        ("custom", "Custom range", none, none),
    ]
    rows = F.array(*[
        F.struct(F.lit(i).alias("preset_ord"), F.lit(key).alias("key"), F.lit(label).alias("label"),
                 a.alias("range_start"), b.alias("range_end"))
        for i, (key, label, a, b) in enumerate(presets)])
    return bounds.select(F.inline(rows))


def custom_range(start: dt.date | None, end: dt.date | None, bounds: DateRange) -> DateRange | None:
    """A typed-in range; open ends fall back to the data's bounds, and a reversed range is no range."""
    span = (start or bounds[0], end or bounds[1])
    return span if span[0] <= span[1] else None
