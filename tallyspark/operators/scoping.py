"""Row filters: closed date range, channel, currency, placeholder exclusion."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import text_or_null
from ..sources.schema import UNKNOWN

DateRange = tuple[dt.date, dt.date]
#: How many raw rows a row of a folded feed stands for.
ROWS = "_rows"


def row_weight(df: DataFrame) -> Column:
    return F.col(ROWS) if ROWS in df.columns else F.lit(1).cast("bigint")


def count_rows(df: DataFrame) -> Column:
    """Number of raw rows, of a feed or of its fold."""
    return F.sum(ROWS) if ROWS in df.columns else F.count(F.lit(1))


def currency_code(c: Column) -> Column:
    return F.upper(text_or_null(c))


def real_dimension(c: Column) -> Column:
    """True for a dimension value that is neither missing nor the placeholder cleaning fills in."""
    return c.isNotNull() & (c != "") & (c != UNKNOWN)


def in_range(df: DataFrame, column: str, span: DateRange | None) -> DataFrame:
    if span is None:
        return df
    return df.filter(F.col(column).between(F.lit(span[0]), F.lit(span[1])))


def in_channel(df: DataFrame, channel: str | None) -> DataFrame:
    return df if not channel else df.filter(F.col("channel") == channel)


def in_currency(df: DataFrame, currency: str | None) -> DataFrame:
    return df if not currency else df.filter(currency_code(F.col("currency")) == currency)


def month_span(first: dt.date) -> DateRange:
    """First and last day of the month ``first`` lies in."""
    start = first.replace(day=1)
    following = (start + dt.timedelta(days=32)).replace(day=1)
    return start, following - dt.timedelta(days=1)


def previous_month(first: dt.date) -> dt.date:
    """First day of the month before."""
    return (first.replace(day=1) - dt.timedelta(days=1)).replace(day=1)


def in_month(df: DataFrame, column: str, first: dt.date) -> DataFrame:
    """Month filter written as a day range, so it reaches the scan."""
    return in_range(df, column, month_span(first))


def in_quarter(df: DataFrame, column: str, first: dt.date) -> DataFrame:
    start = first.replace(month=3 * ((first.month - 1) // 3) + 1, day=1)
    return in_range(df, column, (start, month_span(start.replace(month=start.month + 2))[1]))


def previous_span(span: DateRange) -> DateRange:
    start, end = span
    days = (end - start).days
    return start - dt.timedelta(days=days + 1), start - dt.timedelta(days=1)


def by_columns(df: DataFrame, by: tuple[str, ...]) -> list[Column]:
    """Grouping columns of a batch over scopes; currency is always compared in upper case, with a name for blanks."""
    return [
        F.coalesce(currency_code(F.col(b)), F.lit(UNKNOWN.upper())).alias(b) if b == "currency" else F.col(b)
        for b in by
    ]
