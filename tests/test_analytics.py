"""Detectors, KPIs, rankings, currencies, reconciliation and risks: brute force and edge cases."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import anomalies as an
from tallyspark.operators import buckets, crossref, currency, kpi, performers, ranges, risks, scoping
from tallyspark.sources import star

SF = "/root/testdata/sf0.01"
D = dt.date


def sales_rows(spark, rows):
    """rows: (day, sku, region, channel, units, revenue, currency)"""
    df = spark.createDataFrame(
        [(*r, i) for i, r in enumerate(rows)],
        "date date, sku string, region string, channel string, units double, revenue double, currency string, _ord bigint")
    return df.withColumn("revenue", F.col("revenue").cast("decimal(18,4)"))


def series(spark, values):
    return spark.createDataFrame(
        [("x", D(2025, 1, 1) + dt.timedelta(days=31 * i), float(v), 1) for i, v in enumerate(values)],
        "dimension_value string, start date, value double, n_rows bigint").withColumn("start", F.trunc("start", "MM"))


def test_zscore_by_brute_force(spark):
    rng = random.Random(7)
    values = [rng.randint(1, 20) for _ in range(30)] + [90]
    mean = sum(values) / len(values)
    sd = math.sqrt(sum((v - mean) ** 2 for v in values) / len(values))
    got = an.zscore_outliers(series(spark, values), 2.0, "sku", "month", an.WEEKLY_UNITS).collect()
    want = [(v, (v - mean) / sd) for v in values if abs((v - mean) / sd) >= 2.0]
    assert [(r["observed"], r["deviation"]) for r in got] == want
    assert all(r["severity"] == ("high" if abs(r["deviation"]) >= 3.5 else "medium") for r in got)
    assert got[-1]["direction"] == "above" and got[-1]["baseline"] == mean


def test_short_and_flat_series_are_not_judged(spark):
    for values in ([1, 1, 1, 1, 99], [4] * 10):
        assert an.zscore_outliers(series(spark, values), 0.1, "sku", "month", an.WEEKLY_UNITS).count() == 0
        assert an.iqr_outliers(series(spark, values), 0.1, "sku", "month", an.WEEKLY_UNITS).count() == 0


def test_iqr_fence_is_exclusive(spark):
    # quartiles of 1,2,3,4,10,20 are 2.25 and 8.5
    rows = an.iqr_outliers(series(spark, [1, 2, 3, 4, 10, 20]), 1.5, "sku", "month", an.WEEKLY_UNITS).collect()
    assert [(r["observed"], r["baseline"], r["severity"]) for r in rows] == [(20.0, 5.375, "medium")]
    fence = (20 - 8.5) / 6.25
    assert an.iqr_outliers(series(spark, [1, 2, 3, 4, 10, 20]), fence, "sku", "month", an.WEEKLY_UNITS).count() == 0


def test_z_threshold_is_inclusive(spark):
    # mean 1, deviation 1: z is exactly +1 or -1
    rows = an.zscore_outliers(series(spark, [0, 2] * 4), 1.0, "sku", "month", an.WEEKLY_UNITS)
    assert rows.count() == 8


def test_rolling_uses_present_months_and_skips_zero_baselines(spark):
    got = an.rolling_baseline(series(spark, [100, 100, 100, 60, 100, 100, 100]), 0.25).collect()
    assert [(round(r["deviation"], 4), r["direction"], r["severity"]) for r in got] == [(-0.4, "below", "high")]
    assert an.rolling_baseline(series(spark, [0, 0, 0, 50]), 0.25).count() == 0
    # a negative baseline turns the sign of the shift
    flipped = an.rolling_baseline(series(spark, [-10, -10, -10, -20]), 0.25).first()
    assert flipped["deviation"] == 1.0 and flipped["direction"] == "above"


def test_known_counts_on_the_star_tables(spark):
    sales = star.sales(spark, SF, ["date", "sku", "units"])
    weeks = an.sku_week_units(sales).persist()
    z = an.zscore_outliers(weeks, an.THRESHOLDS["zscore"], "sku", "week", an.WEEKLY_UNITS)
    q = an.iqr_outliers(weeks, an.THRESHOLDS["iqr"], "sku", "week", an.WEEKLY_UNITS)

    def tally(df):
        return {r["sensitivity"]: (r["n"], r["high"]) for r in df.groupBy("sensitivity").agg(
            F.count("*").alias("n"), F.count_if(F.col("severity") == "high").alias("high")).collect()}

    assert tally(z) == {"strict": (43, 0), "standard": (489, 5), "lenient": (2166, 108)}
    assert {k: n for k, (n, _) in tally(q).items()} == {"strict": 22, "standard": 397, "lenient": 2130}
    regional = star.sales(spark, SF, ["date", "region", "revenue"])
    rolling = an.region_revenue_anomalies(regional, an.THRESHOLDS["rolling-baseline"])
    assert tally(rolling) == {"strict": (5, 5), "standard": (19, 5), "lenient": (84, 21)}
    weeks.unpersist()


def test_drill_down_adds_up(spark):
    sales = star.sales(spark, SF, ["date", "sku", "units"], order=True)
    top = an.strongest(an.sku_unit_anomalies(sales, "zscore", 2.5).withColumn("detector_ord", F.lit(0)), 5)
    rows = an.drill_down(sales, "date", "week", "sku", top, ["date", "sku", "units"], sample=1000)
    summed = {r["id"]: (r["s"], r["n"]) for r in rows.groupBy("id").agg(
        F.sum("units").alias("s"), F.count("*").alias("n")).collect()}
    assert summed == {r["id"]: (r["observed"], r["n_rows"]) for r in top.collect()}


def test_drill_down_beyond_the_broadcast_bound(spark, monkeypatch):
    monkeypatch.setattr(an, "small_side", lambda df: df)
    sales = star.sales(spark, SF, ["date", "sku", "units"], order=True)
    top = an.strongest(an.sku_unit_anomalies(sales, "zscore", 2.5).withColumn("detector_ord", F.lit(0)), 3)
    assert an.drill_down(sales, "date", "week", "sku", top, ["date", "units"], sample=1).count() == 3


def test_placeholder_dimensions_take_no_part(spark):
    sales = sales_rows(spark, [(D(2025, 1, 1), s, "r", "c", 1.0, 1.0, "USD") for s in ("a", "Unknown", "", None, "unknown")])
    got = buckets.bucket(sales, "date", "month", "units", "sku").select("dimension_value").collect()
    assert {r[0] for r in got} == {"a", "unknown"}


def _kpi_feed(spark):
    sales = sales_rows(spark, [
        (D(2025, 2, 5), "a", "r", "c", 10.0, 100.0, "USD"), (D(2025, 3, 5), "a", "r", "c", 20.0, 150.0, "usd"),
        (D(2025, 3, 9), "b", "r", "c", 5.0, 50.0, "USD"), (D(2024, 3, 1), "a", "r", "c", 4.0, 40.0, "USD"),
        (D(2024, 12, 1), "a", "r", "c", 1.0, 10.0, "USD")])
    orders = spark.createDataFrame([(D(2025, 3, 5), "USD"), (D(2025, 3, 5), "USD")], "orderDate date, currency string")
    returns = spark.createDataFrame([(D(2025, 3, 20), 5.0, "USD")], "returnDate date, units double, currency string")
    cost = spark.createDataFrame([("a", 2.0)], "sku string, unitCost double").withColumn(
        "unitCost", F.col("unitCost").cast("decimal(18,4)"))
    return sales, orders, returns, cost


@pytest.mark.parametrize("small", [True, False])
def test_kpi_trend_by_hand(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(kpi, "SMALL_COSTS", 0)
    rows = {r["kpi"]: r for r in kpi.kpi_trend(*_kpi_feed(spark)).collect()}
    assert rows["revenue"]["anchor_month"] == "2025-03"
    assert (rows["revenue"]["current"], rows["revenue"]["mom"]) == (200.0, 1.0)
    assert rows["revenue"]["qoq"] == (300 - 10) / 10 and rows["revenue"]["yoy"] == 4.0
    assert rows["units"]["current"] == 25.0
    # orders are counted by row; none before, so there is nothing to compare with
    assert rows["orders"]["current"] == 2.0 and rows["orders"]["mom"] is None
    assert rows["returnRate"]["current"] == 0.2 and rows["returnRate"]["mom"] is None
    # the SKU without a cost counts as cost 0
    assert rows["avgMargin"]["current"] == pytest.approx((200 - 40) / 200)


def test_kpi_gaps_are_null(spark):
    sales, orders, _, _ = _kpi_feed(spark)
    rows = {r["kpi"]: r for r in kpi.kpi_trend(sales, None, None, None).collect()}
    assert rows["returnRate"]["current"] is None and rows["avgMargin"]["current"] is None
    empty = spark.createDataFrame([], "returnDate date, units double, currency string")
    rows = {r["kpi"]: r for r in kpi.kpi_trend(sales, orders, empty, None).collect()}
    assert rows["returnRate"]["current"] == 0.0
    assert kpi.kpi_trend(sales.limit(0), orders, None, None).count() == 0


def test_kpi_range_compares_with_the_range_before(spark):
    feed = _kpi_feed(spark)
    rows = {r["kpi"]: r for r in kpi.kpi_range_trend(*feed, (D(2025, 3, 1), D(2025, 3, 31))).collect()}
    # the 31 days before March hold the February sale
    assert rows["revenue"]["current"] == 200.0 and rows["revenue"]["mom"] == 1.0
    assert rows["revenue"]["qoq"] is None and rows["revenue"]["anchor_month"] is None


def test_snapshot_shares(spark):
    row = kpi.kpi_snapshot(*_kpi_feed(spark)).first()
    assert row["revenue"] == 350.0 and row["costedRevenueShare"] == pytest.approx(300 / 350)


def test_unit_cost_is_the_first_in_file_order(spark):
    stock = spark.createDataFrame([("a", 3.0, 5), ("a", 2.0, 1), ("b", None, 2)], "sku string, unitCost double, _ord bigint")
    stock = stock.withColumn("unitCost", F.col("unitCost").cast("decimal(18,4)"))
    assert {r["sku"]: float(r["unitCost"]) for r in kpi.unit_cost_by_sku(stock).collect()} == {"a": 2.0, "b": 0.0}


def test_currencies_sum_to_the_whole(spark):
    sales = star.sales(spark, SF, ["revenue", "units", "currency"])
    parts = currency.currency_breakdown(sales, None, None).agg(F.sum("revenue"), F.sum("units")).first()
    assert parts[0] == pytest.approx(3_024_008_727.8907) and parts[1] == 1_524_135


def test_unknown_currency(spark):
    day = D(2025, 1, 1)
    sales = sales_rows(spark, [(day, "a", "r", "c", 1.0, 1.0, c) for c in ("eur", "USD", "Unknown", "Unknown", "Unknown")])
    assert [r[0] for r in currency.available_currencies(sales, None).collect()] == ["EUR", "UNKNOWN", "USD"]
    assert [r[0] for r in currency.available_currencies(sales, include_unknown=False).collect()] == ["EUR", "USD"]
    # a tie goes to the first row of the file, the placeholder never wins
    assert currency.default_currency(sales).first()["currency"] == "EUR"
    assert currency.default_currency(sales.filter("currency = 'Unknown'")).count() == 0
    assert scoping.in_currency(sales, "EUR").count() == 1


def test_performers(spark):
    sales = sales_rows(spark, [
        (D(2025, 2, 1), "gone", "r", "c", 1.0, 10.0, "USD"), (D(2025, 3, 1), "new", "r", "c", 1.0, 30.0, "USD"),
        (D(2025, 2, 1), "up", "r", "c", 1.0, 10.0, "USD"), (D(2025, 3, 1), "up", "r", "c", 1.0, 20.0, "USD"),
        (D(2025, 2, 1), "refunded", "r", "c", 1.0, -5.0, "USD"), (D(2025, 3, 1), "refunded", "r", "c", 1.0, 1.0, "USD"),
        (D(2025, 3, 1), "Unknown", "r", "c", 1.0, 99.0, "USD"), (D(2025, 1, 1), "old", "r", "c", 1.0, 99.0, "USD")])
    latest = performers.performers_latest_month(sales, "sku")
    got = [tuple(r) for r in performers.ranked_performers(latest).collect()]
    assert got == [("new", 30.0, None, None), ("up", 20.0, 10.0, 1.0), ("refunded", 1.0, None, None),
                   ("gone", 0.0, 10.0, -1.0)]
    assert {tuple(r)[1:] for r in performers.performers_latest_month(sales, "sku", ("currency",)).collect()} == set(got)
    sides = performers.top_bottom(latest, 3).collect()
    assert [r["dimension_value"] for r in sides if r["side"] == "bottom"] == ["gone", "refunded", "up"]
    assert [r[0] for r in performers.available_channels(sales, None).collect()] == ["c"]


def test_hot_key_reconciliation(spark):
    left = spark.range(100_000).select(F.when(F.col("id") < 90_000, "hot").otherwise(
        F.concat(F.lit("k"), (F.col("id") % 10).cast("string"))).alias("sku"))
    left = left.unionByName(spark.createDataFrame([("Unknown",), ("",), (None,)], "sku string"))
    right = spark.createDataFrame([("hot",), ("k1",)], "sku string")
    assert tuple(crossref.match_counts(left, right, "sku").first()) == (11, 9)
    assert tuple(crossref.match_counts(left, right, "sku", keep_placeholder=True).first()) == (12, 10)


def test_cross_reference_needs_two_feeds(spark):
    sku = spark.createDataFrame([("a",)], "sku string")
    alone = crossref.cross_reference(sku, None, None, None).collect()
    assert [(r["label"], r["clean"]) for r in alone] == [("Cross-reference skipped", True)]
    pair = crossref.cross_reference(sku, None, sku, None).first()
    assert pair["detail"] == "All 1 SKUs sold have a matching inventory record."


def test_ranges(spark):
    bounds = (D(2025, 1, 10), D(2026, 1, 15))
    frame = spark.createDataFrame([bounds], "start date, end date")
    got = {r["key"]: (r["range_start"], r["range_end"]) for r in ranges.range_presets(frame).collect()}
    assert got["lastMonth"] == (D(2025, 12, 1), D(2025, 12, 31))
    assert got["thisQuarter"] == (D(2026, 1, 1), bounds[1]) and got["custom"] == (None, None)
    assert ranges.custom_range(None, D(2025, 2, 1), bounds) == (D(2025, 1, 10), D(2025, 2, 1))
    assert ranges.custom_range(D(2025, 3, 1), D(2025, 2, 1), bounds) is None
    assert scoping.previous_span((D(2025, 3, 1), D(2025, 3, 10))) == (D(2025, 2, 19), D(2025, 2, 28))


def test_overlap(spark):
    rows = spark.createDataFrame([("w", D(2025, 1, 26), D(2025, 2, 1)), ("m", D(2025, 3, 1), D(2025, 3, 31))],
                                 "id string, span_start date, span_end date")
    got = an.overlapping(rows, (D(2025, 2, 1), D(2025, 2, 28))).collect()
    assert [r["id"] for r in got] == ["w"]
    assert an.overlapping(rows, None).count() == 2


def _stock(spark, rows):
    return spark.createDataFrame(
        [(*r, i) for i, r in enumerate(rows)],
        "sku string, productName string, warehouse string, onHand double, reorderPoint double, _ord bigint")


def test_inventory_risk(spark):
    stock = _stock(spark, [("a", "Lamp", "W1", 5.0, 5.0), ("b", "Unknown", "Unknown", 1.0, 9.5), ("c", "Tent", "W1", 0.0, 0.0),
                           ("d", "Boot", "W2", 6.0, 5.0)])
    assert [(r["label"], r["warehouse"]) for r in risks.inventory_risk(stock).collect()] == [
        ("b", "Unspecified warehouse"), ("Lamp", "W1")]
    details = [r["detail"] for r in risks.stockout_risks(stock).orderBy("_ord").collect()]
    assert details == ["5 units on hand at W1 vs. a reorder point of 5.",
                       "1 units on hand at an unspecified warehouse vs. a reorder point of 9.5."]


def test_risk_list_order_and_cap(spark):
    def ranking(rows):
        return spark.createDataFrame(rows, "dimension_value string, current double, previous double, delta_pct double")

    sku = ranking([("s1", 10.0, 5.0, 1.0), ("s2", 13.0, 10.0, 0.3), ("s3", 9.0, None, None)])
    region = ranking([("East", 1.0, 4.0, -0.75), ("West", 5.0, 10.0, -0.5)])
    values = [1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 1, 2, 60]
    found = an.zscore_outliers(series(spark, values), 1.9, "sku", "month", an.WEEKLY_UNITS).withColumn(
        "detector_ord", F.lit(0))
    stock = _stock(spark, [("a", f"P{i}", "W", 0.0, 1.0) for i in range(3)])
    got = [(r["item"], r["type"], r["title"]) for r in risks.risk_flags(stock, sku, region, found).orderBy("item").collect()]
    assert got == [(1, "risk", "Stockout risk: P0"), (2, "risk", "Stockout risk: P1"), (3, "risk", "Stockout risk: P2"),
                   (4, "opportunity", "s1 demand accelerating"), (5, "risk", "East region demand declining"),
                   (6, "opportunity", "Weekly units sold anomaly — x")]
    assert risks.risk_flags(stock, sku, region, found, cap=2).count() == 2
    assert risks.risk_flags(None, sku, region, found).count() == 3


def test_one_currency_with_most_of_the_rows(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") % 10 < 9, "usd").otherwise("EUR").alias("currency"),
        (F.col("id") % 500).cast("string").alias("sku"), F.lit(1).cast("decimal(18,4)").alias("revenue"))
    got = currency.dimension_by_currency(rows, "sku").collect()
    want = {(r["currency"], r["sku"]): r["n"] for r in rows.groupBy(F.upper("currency").alias("currency"), "sku").agg(
        F.count("*").alias("n")).collect()}
    assert {(r["currency"], r["dimension_value"]): r["current"] for r in got} == want
    assert {(r["currency"], r["group_total"]) for r in got} == {("USD", 18_000.0), ("EUR", 2_000.0)}
    assert got[0]["currency"] == "USD"


def test_trend_reads_only_the_months_it_needs(spark):
    """The date bound of the year before reaches every scan."""
    from tallyspark.plans.queries import QUERIES

    plan = QUERIES["kpi_trend"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    for column in ("l_shipdate", "o_orderdate"):
        assert any(f"GreaterThanOrEqual({column}" in line for line in pushed), column
