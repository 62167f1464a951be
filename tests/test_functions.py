"""Column functions on literal rows."""

import datetime as dt
import decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import coerce, dates, fmt, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def texts(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in rows.select("i", fn(F.col("v"))).orderBy("i").collect()]


def numbers(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    return [r[1] for r in rows.select("i", fn(F.col("v"))).orderBy("i").collect()]


def test_numbers(spark):
    cases = {"$1,234.50": 1234.5, "$": 0.0, "1e3": 1000.0, "5.": 5.0, ".5": 0.5, "+7": 7.0, "-2": -2.0, "$ 5": 5.0,
             "abc": None, "1d": None, "inf": None, "NaN": None, "0x1F": None, "(5)": None, "€5": None, "1.5f": None,
             "1 2": None}
    assert texts(spark, list(cases), coerce.parse_number) == list(cases.values())


def test_money_is_exact_and_out_of_range_is_null(spark):
    cells = ["0.1", "1,000,000.25", "1e20", "100000000000000.00", "0.00004", "1e29"]
    want = ["0.1", "1000000.25", "1e20", "1e14", "0.00004", None]
    got = texts(spark, cells, coerce.parse_money)
    assert got == [None if w is None else decimal.Decimal(w) for w in want]


def test_days(spark):
    cases = {
        "2025-03-04": (2025, 3, 4), "2025/3/4": (2025, 3, 4), "02/03/2025": (2025, 2, 3), "2-3-2025": (2025, 2, 3),
        "2025-03-04T10:00:00Z": (2025, 3, 4), "2025-03-04T23:30:00-05:00": (2025, 3, 5), "2025-03-04 10:00": (2025, 3, 4),
        "Mar 4, 2025": (2025, 3, 4), "March 4 2025": (2025, 3, 4), "4 Mar 2025": (2025, 3, 4), "Tue Mar 04 2025": (2025, 3, 4),
        "04-Mar-2025": (2025, 3, 4), "3/4/2025 5:30 PM": (2025, 3, 4), "2025-03": (2025, 3, 1), "2025": (2025, 1, 1),
        "6/1/25": (2025, 6, 1), "6/1/99": (1999, 6, 1), "01-Jun-25": (2025, 6, 1), "2025-06-01 10:30:00+00": (2025, 6, 1),
        "2025-06-01 10:30:00+00:00": (2025, 6, 1), "2025-06-01 23:30:00-05": (2025, 6, 2), "June 2025": (2025, 6, 1),
        "Mon, 02 Jun 2025 00:00:00 GMT": (2025, 6, 2), "2025-02-30": None, "13/40/2025": None, "not a date": None, "45": None, "": None,
        "2025-06-01 10:30:00 +00:00": (2025, 6, 1), "2025-06-01 10:30:00 UTC": (2025, 6, 1), "2025-06-01 22:30:00 EST": (2025, 6, 2),
        "Mon, 02 Jun 2025 00:00:00 +0530": (2025, 6, 1), "June 1, 2025 10:30:00 GMT+0200": (2025, 6, 1),
        "Sun Jun 01 2025 00:00:00 GMT+0000 (Coordinated Universal Time)": (2025, 6, 1), "6/1/2025 11:30 PM PST": (2025, 6, 2),
        "2025-06-01 00:10 GMT+02": (2025, 5, 31), "12/31/2024 12:05 AM UTC": (2024, 12, 31), "Jun-25": (2001, 6, 25), "Jun-2025": (2025, 6, 1),
        "6.1.2025": (2025, 6, 1), "31.12.2025": None, "20250601": None, "June 31, 2025 10:00 UTC": None, "soon 10:30 UTC": None,
    }
    want = [dt.date(*v) if v else None for v in cases.values()]
    assert texts(spark, list(cases), coerce.parse_day) == want


def test_trim_takes_every_blank(spark):
    assert texts(spark, ["  x﻿", "\t\n", "a b"], coerce.trim_blanks) == ["x", "", "a b"]


def test_week_starts_on_sunday(spark):
    assert one(spark, dates.week_key(F.lit(dt.date(2026, 2, 11)))) == "2026-02-08"
    assert one(spark, dates.week_key(F.lit(dt.date(2026, 2, 8)))) == "2026-02-08"


def test_keys_shifts_and_labels(spark):
    d = F.lit(dt.date(2026, 1, 31))
    assert one(spark, dates.quarter_key(d)) == "2026-Q1"
    assert one(spark, dates.quarter_key(dates.shift_quarter(dates.quarter_start(d), -1))) == "2025-Q4"
    assert one(spark, dates.month_key(dates.shift_month(dates.month_start(d), -1))) == "2025-12"
    assert one(spark, dates.month_label(d)) == "Jan 2026"
    assert one(spark, dates.range_label(d, d)) == "Jan 31, 2026"
    assert one(spark, dates.range_label(d, F.lit(dt.date(2026, 2, 1)))) == "Jan 31, 2026 – Feb 1, 2026"
    before = dates.previous_range(F.lit(dt.date(2026, 3, 1)), F.lit(dt.date(2026, 3, 10)))
    assert [one(spark, b) for b in before] == [dt.date(2026, 2, 19), dt.date(2026, 2, 28)]
    assert one(spark, dates.period_end("week", F.lit(dt.date(2026, 2, 8)))) == dt.date(2026, 2, 14)


def test_counts_round_halves_up(spark):
    assert numbers(spark, [2.5, -2.5, 1234567.5, -0.4, 0.49999999999999994], fmt.format_number) == [
        "3", "-2", "1,234,568", "-0", "0"]


def test_fixed_digits_follow_the_binary_value(spark):
    # 1.45 lies just below its spelling, 0.25 is exact, 8.345e-1 * 100 is judged after the product
    values = [1.45, 0.25, -0.25, 0.05, 2.675, -0.04, 12.0]
    assert numbers(spark, values, lambda c: fmt.fixed(c, 1)) == ["1.4", "0.3", "-0.3", "0.1", "2.7", "-0.0", "12.0"]
    assert numbers(spark, [0.5, 1.5, -0.5, 29.49], lambda c: fmt.fixed(c, 0)) == ["1", "2", "-1", "29"]


@pytest.mark.parametrize("code,want", [
    ("USD", "$1,235"), ("eur", "€1,235"), ("INR", "₹1,235"), ("CAD", "CA$1,235"), ("CHF", "CHF 1,235"),
    ("dollars", "dollars 1,235")])
def test_currency(spark, code, want):
    assert one(spark, fmt.format_currency(F.lit(1234.5), F.lit(code))) == want


def test_currency_negative(spark):
    assert one(spark, fmt.format_currency(F.lit(-1234.5), F.lit("USD"))) == "-$1,235"


def test_kpi_delta_deviation_and_caption(spark):
    none = F.lit(None).cast("double")
    assert one(spark, fmt.format_kpi(none, F.lit("number"), F.lit("USD"))) == "—"
    assert one(spark, fmt.format_kpi(F.lit(0.1234), F.lit("percent"), F.lit("USD"))) == "12.3%"
    assert numbers(spark, [None, 0.5, -0.123, 0.0], fmt.format_delta) == ["N/A", "+50.0%", "-12.3%", "0.0%"]
    assert one(spark, fmt.format_deviation(F.lit("zscore"), F.lit(2.5))) == "z = 2.5"
    assert one(spark, fmt.format_deviation(F.lit("iqr"), F.lit(1.26))) == "1.3x IQR"
    assert one(spark, fmt.format_deviation(F.lit("rolling-baseline"), F.lit(0.3))) == "+30% vs. trailing avg"
    assert one(spark, fmt.format_method(F.lit("iqr"), F.lit(1.5))) == "IQR method, multiplier 1.5"
    assert one(spark, fmt.format_method(F.lit("zscore"), F.lit(3.0))) == "z-score method, threshold 3"
    assert one(spark, fmt.format_method(F.lit("rolling-baseline"), F.lit(0.25))) == (
        "rolling 3-month baseline, threshold 25%")


def test_plain_numbers(spark):
    assert numbers(spark, [5.0, 2.5, 100.0, 12345678.25, -3.0], fmt.plain_number) == [
        "5", "2.5", "100", "12345678.25", "-3"]


def test_polarity(spark):
    def polarity(d, better):
        return one(spark, fmt.delta_polarity(F.lit(d).cast("double"), F.lit(better)))

    assert [polarity(0.1, True), polarity(0.1, False), polarity(0.0, True), polarity(None, True)] == [
        "good", "bad", "neutral", "neutral"]


def test_header_text(spark):
    assert texts(spark, ["Order Date", "order_date", "OrderDate"], text.normalize_header) == ["orderdate"] * 3
    assert texts(spark, ["sales-record-id", "orderNo", "Price"], text.word_tokens) == [
        ["sales", "record", "id"], ["order", "no"], ["price"]]
    assert texts(spark, ["sales-record-id", "purchase-order-number", "Paid"], text.is_identifier_header) == [
        True, True, False]
    assert one(spark, text.similarity(F.lit("prodcutname"), F.lit("productname"))) == pytest.approx(9 / 11)


def test_note_line_and_slug(spark):
    assert texts(spark, ["- 1) Prime Day", "2. Sale ", "***", "plain"], text.note_line) == ["Prime Day", "Sale", "", "plain"]
    assert one(spark, text.slug(F.lit("Jun  2026"))) == "jun-2026"
