"""Calendar keys, shifts and labels. Dates stay DateType until the last step, so grouping and pruning work on ints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_start(d: Column) -> Column:
    return F.trunc(d, "MM").cast("date")


def quarter_start(d: Column) -> Column:
    return F.trunc(d, "quarter").cast("date")


def week_start(d: Column) -> Column:
    """The Sunday on or before ``d`` (Spark's own week truncation starts on Monday)."""
    return F.date_sub(d, F.dayofweek(d) - 1)


def month_key(d: Column) -> Column:
    return F.date_format(d, "yyyy-MM")


def quarter_key(d: Column) -> Column:
    return F.concat(F.date_format(d, "yyyy"), F.lit("-Q"), F.quarter(d).cast("string"))


def week_key(d: Column) -> Column:
    return F.date_format(week_start(d), "yyyy-MM-dd")


def shift_month(first: Column, n: int) -> Column:
    return F.add_months(first, n)


def shift_quarter(first: Column, n: int) -> Column:
    return F.add_months(first, 3 * n)


def month_end(d: Column) -> Column:
    return F.last_day(d)


GRAIN_START = {"month": month_start, "quarter": quarter_start, "week": week_start}


def period_key(grain: str, start: Column) -> Column:
    """Text key of a period given its first day."""
    if grain == "month":
        return month_key(start)
    if grain == "quarter":
        return quarter_key(start)
    return F.date_format(start, "yyyy-MM-dd")


def period_end(grain: str, start: Column) -> Column:
    if grain == "month":
        return F.last_day(start)
    if grain == "quarter":
        return F.last_day(F.add_months(start, 2))
    return F.date_add(start, 6)


def previous_range(start: Column, end: Column) -> tuple[Column, Column]:
    """The equally long range that ends the day before ``start``."""
    length = F.datediff(end, start)
    return F.date_sub(start, length + 1), F.date_sub(start, 1)


def day_label(d: Column) -> Column:
    return F.date_format(d, "MMM d, yyyy")


def range_label(start: Column, end: Column) -> Column:
    return F.when(start == end, day_label(start)).otherwise(F.concat(day_label(start), F.lit(" – "), day_label(end)))


def month_label(d: Column) -> Column:
    return F.date_format(d, "MMM yyyy")
