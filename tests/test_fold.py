"""Folded feeds give what raw feeds give, and are the only readers of raw rows."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import anomalies as an
from tallyspark.operators import currency, kpi, performers
from tallyspark.operators.buckets import bucket
from tallyspark.operators.fold import ALL_CHANNELS, all_scopes, daily_fold, staged_folds
from tallyspark.plans import queries, report

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def feeds(spark):
    """Dirty currencies and channels, missing days, a hot SKU and repeated lines."""
    rng = random.Random(4)
    code = lambda: rng.choice(["usd", "USD", "EUR", "eur", "", None, "Unknown"])
    day = lambda: rng.choice([None, *(dt.date(2024, 1, 1) + dt.timedelta(days=rng.randint(0, 500)) for _ in range(9))])
    sales = [(day(), rng.choice(["A", "A", "A", "B", "C", "Unknown"]), rng.choice(["N", "S", "Unknown"]), rng.choice(["web", "shop", "Unknown"]),
              float(rng.randint(1, 9)), Decimal(rng.randint(1, 9999)) / 100, code(), i) for i in range(1500)]
    orders = [(day(), rng.choice(["web", "mail"]), code(), i) for i in range(400)]
    returns = [(day(), rng.choice(["A", "B"]), float(rng.randint(1, 3)), Decimal(rng.randint(1, 99)), code(), i) for i in range(300)]
    return {
        "sales": spark.createDataFrame(sales, "date date, sku string, region string, channel string, units double, revenue decimal(18,4), currency string, _ord long"),
        "orders": spark.createDataFrame(orders, "orderDate date, channel string, currency string, _ord long"),
        "returns": spark.createDataFrame(returns, "returnDate date, sku string, units double, refund decimal(18,4), currency string, _ord long")}


def same(a, b):
    names = a.columns
    text = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*names).collect())
    assert text(a) == text(b)


def test_every_operator_takes_a_fold(spark, feeds):
    folds = staged_folds(feeds)
    by = ("currency",)
    costs = spark.createDataFrame([("A", 1.5), ("B", 2.0)], "sku string, unitCost double")
    s, o, r = (feeds[n] for n in ("sales", "orders", "returns"))
    fs, fo, fr = (folds[n] for n in ("sales", "orders", "returns"))
    assert fs.count() < s.count() and fs.agg(F.sum("_rows")).first()[0] == 1500
    for grain in ("week", "month"):
        same(bucket(s, "date", grain, "units", "sku", by), bucket(fs, "date", grain, "units", "sku", by))
        same(bucket(s, "date", grain, "revenue"), bucket(fs, "date", grain, "revenue"))
    same(kpi.kpi_trend(s, o, r, costs, by), kpi.kpi_trend(fs, fo, fr, costs, by))
    same(kpi.kpi_snapshot(s, o, r, costs, by), kpi.kpi_snapshot(fs, fo, fr, costs, by))
    same(currency.currency_breakdown(s, o, r), currency.currency_breakdown(fs, fo, fr))
    same(currency.default_currency(s), currency.default_currency(fs))
    same(currency.available_currencies(s, o, r), currency.available_currencies(fs, fo, fr))
    same(performers.performers_latest_month(s, "region", by), performers.performers_latest_month(fs, "region", by))
    same(an.detect_anomalies(s, r, by=by), an.detect_anomalies(fs, fr, by=by))
    same(daily_fold(s, "sales"), daily_fold(fs, "sales"))
    same(daily_fold(s, "sales", ("sku",)), daily_fold(fs, "sales", ("sku",)))


def test_scopes_of_a_fold(feeds):
    fold = daily_fold(feeds["sales"], "sales")
    scopes = all_scopes(fold, "sales")
    one = scopes.where("channel = 'web' and currency = 'USD'").agg(F.sum("revenue"), F.sum("_rows")).first()
    want = feeds["sales"].where("channel = 'web' and upper(currency) = 'USD'").agg(F.sum("revenue"), F.count("*")).first()
    assert tuple(one) == tuple(want)
    whole = scopes.where(F.col("channel") == ALL_CHANNELS).agg(F.sum("revenue"), F.sum("_rows")).first()
    assert tuple(whole) == tuple(feeds["sales"].agg(F.sum("revenue"), F.count("*")).first())


def parts(folder, feeds):
    out = {}
    for name, df in feeds.items():
        df.repartition(2).write.parquet(f"{folder}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{folder}/{name}")
    return out


def test_raw_rows_are_read_by_the_folds_only(feeds, tmp_path):
    raw = parts(tmp_path, feeds)
    built = report.build_report(raw | {"inventory": None})
    scopes = report.report_all_scopes(raw | {"inventory": None})
    for table in (*built.values(), *scopes.values()):
        assert not [f for f in table.inputFiles() if str(tmp_path) in f]
    for name, df in raw.items():
        plan = daily_fold(df, name)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1


@pytest.mark.parametrize("name", ["risk_flags", "anomalies_ranked", "risk_rules"])
def test_queries_read_folds(spark, name):
    files = queries.QUERIES[name](spark, SF).inputFiles()
    assert not [f for f in files if SF in f and not ("part.parquet" in f or name == "risk_flags" and "lineitem" in f)]  # stock alone


def test_all_scopes_agree_with_one_report_each(feeds):
    every = report.report_all_scopes(feeds | {"inventory": None})
    kpis = every["kpis"].collect()
    for currency_, channel in (("USD", None), ("EUR", "web")):
        one = report.build_report(feeds | {"inventory": None}, report.ReportScope(channel=channel, currency=currency_))
        own = {r["kpi"]: r for r in kpis if (r["currency"], r["channel"]) == (currency_, channel or ALL_CHANNELS)}
        for r in one["kpis"].collect():
            for c in ("anchor_month", "current", "mom", "qoq", "yoy", "caveat"):
                assert own[r["kpi"]][c] == (pytest.approx(r[c]) if isinstance(r[c], float) else r[c]), (c, r)
        mine = every["anomalies"].where((F.col("currency") == currency_) & (F.col("channel") == (channel or ALL_CHANNELS)))
        assert sorted(r["id"] for r in mine.collect()) == sorted(r["id"] for r in one["anomalies"].collect())


def scope_of(feeds, **picked):
    r = report.resolve_scope(feeds, report.ReportScope(**picked))
    return r.display, r.channel, r.currency, r.several_currencies, r.anchor


def test_scopes_of_small_feeds(spark):
    d = dt.date
    schema = "date date, channel string, currency string, _ord long"

    def feeds_of(*rows, orders=()):
        return {"sales": spark.createDataFrame(rows, schema), "returns": None,
                "orders": spark.createDataFrame(orders, schema).withColumnRenamed("date", "orderDate") if orders else None}

    none = feeds_of()
    assert scope_of(none) == (None, None, None, False, None)
    assert scope_of(none, span=(d(2024, 1, 1), None)) == (None, None, None, False, None)
    one = feeds_of((d(2024, 2, 10), "web", "usd", 1), (None, "web", "USD", 2))
    assert scope_of(one, currency="EUR") == ((d(2024, 2, 1), d(2024, 2, 29)), None, None, False, d(2024, 2, 1))
    tie = feeds_of((d(2024, 2, 10), "web", "usd", 7), (d(2024, 1, 10), "shop", "eur", 3), (d(2024, 3, 1), "web", "Unknown", 9))
    assert scope_of(tie) == ((d(2024, 3, 1), d(2024, 3, 31)), None, "EUR", True, d(2024, 1, 1))
    assert scope_of(tie, channel="web") == ((d(2024, 3, 1), d(2024, 3, 31)), "web", "USD", True, d(2024, 2, 1))
    assert scope_of(tie, channel="shop")[1] is None  # not in the display range
    assert scope_of(tie, span=(None, d(2024, 2, 1)), currency_scope="display") == ((d(2024, 1, 10), d(2024, 2, 1)), None, None, False, None)
    assert scope_of(tie, span=(d(2024, 3, 1), d(2024, 1, 1)))[0] == (d(2024, 3, 1), d(2024, 3, 31))
    assert scope_of(tie, include_unknown=False, channel="web", span=(d(2024, 2, 1), d(2024, 4, 1)))[2:4] == (None, False)
    ordered = feeds_of((d(2024, 2, 10), "web", "usd", 7), orders=[(d(2024, 2, 11), "mail", "EUR", 1)])
    assert scope_of(ordered, channel="mail") == ((d(2024, 2, 1), d(2024, 2, 29)), "mail", None, False, None)


def test_channels_of_a_fold_are_not_added_up_again(feeds):
    folds = staged_folds(feeds)
    for name in ("sales", "orders", "returns"):
        fold = folds[name]
        scopes = all_scopes(fold, name)
        assert "Expand" not in scopes._jdf.queryExecution().executedPlan().toString()
        dims = [c for c in scopes.columns if c not in ("revenue", "units", "refund", "_rows")]
        assert scopes.groupBy(*dims).count().where("count > 1").count() == 0
        if "channel" in fold.columns:
            same(scopes.where(F.col("channel") != ALL_CHANNELS).select(*dims, "_rows"),
                 fold.where(F.col("channel").isNotNull()).select(*dims, "_rows"))


def test_short_series_leave_before_the_deviations(spark):
    rows = [("long", d, float(d % 3), 1) for d in range(8)] + [("short", d, float(d), 1) for d in range(5)]
    weeks = spark.createDataFrame(rows, "dimension_value string, d int, value double, n_rows int").select(
        "dimension_value", F.date_add(F.lit("2025-01-05").cast("date"), F.col("d") * 7).alias("start"), "value", "n_rows")
    found = an.zscore_outliers(weeks, 0.1, "sku", "week", an.WEEKLY_UNITS)
    lines = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    cut = next(i for i, line in enumerate(lines) if "Filter" in line and ">= 6" in line)
    assert any("Window" in line and "sum(value" in line for line in lines[:cut])
    assert {r["dimension_value"] for r in found.collect()} == {"long"}


def test_unit_costs_are_made_once(spark, feeds, tmp_path):
    stock = spark.createDataFrame([("A", 2.5, 1), ("B", 1.0, 2)], "sku string, unitCost double, _ord int")
    stock = stock.select("sku", F.lit("p").alias("productName"), F.lit("w").alias("warehouse"), F.lit(1.0).alias("onHand"),
                         F.lit(2.0).alias("reorderPoint"), F.col("unitCost").cast("decimal(18,3)").alias("unitCost"), "_ord")
    stock.write.parquet(f"{tmp_path}/stock")
    own = spark.read.parquet(f"{tmp_path}/stock")
    monkey = kpi.SMALL_COSTS
    try:
        kpi.SMALL_COSTS = 1  # too many to broadcast: counted, and then joined
        kpis = report.report_all_scopes(feeds | {"inventory": own})["kpis"]
    finally:
        kpi.SMALL_COSTS = monkey
    assert not [f for f in kpis.inputFiles() if str(tmp_path) in f]
    assert kpis.where("kpi = 'avgMargin' and current is not null").count() > 0
