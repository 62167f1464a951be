"""Whole reports, payloads, stored responses and recall on synthetic feeds with planted anomalies."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import anomalies as an
from tallyspark.operators import cleaning, crossref, responses
from tallyspark.plans import report as rp
from tallyspark.sources import synthetic

D = dt.date
SEED = 2  # a draw in which every planted SKU is sold and returned at its planted time


@pytest.fixture(scope="module")
def world(spark):
    """Eighteen products, four regions, fifteen months, five planted anomalies; cleaned from dirty text."""
    products = spark.range(18).select(
        F.col("id").alias("pick"), F.concat(F.lit("SKU-"), (F.col("id") + 100).cast("string")).alias("sku"),
        F.concat(F.lit("Product "), F.col("id").cast("string")).alias("name"), (F.col("id") * 7 + 20).alias("price"),
        (F.col("id") * 3 + 8).alias("cost"))
    regions = spark.createDataFrame([("North", 1.15), ("South", 0.95), ("East", 0.75), ("West", 1.1)],
                                    "region string, weight double")
    plants = synthetic.Plants(
        slump=("East", D(2026, 1, 1), 0.35), promotion=("SKU-111", D(2025, 11, 20), D(2025, 11, 24), 6),
        spike=("SKU-107", D(2026, 2, 11), 9), defect_wave=("SKU-104", D(2026, 3, 1), 3), stockout=("SKU-116", "DC-East"))
    lines = synthetic.sales_lines(products, regions, D(2025, 4, 1), D(2026, 6, 30), plants, base=10.0, seed=SEED)
    orders = synthetic.order_heads(lines, seed=SEED)
    parts = {"sales": lines, "orders": orders, "inventory": synthetic.stock_rows(products, plants, SEED),
             "returns": synthetic.return_lines(orders, products, plants, SEED)}
    cleaned, injected = {}, {}
    for name, rows in parts.items():
        raw = synthetic.dirty_feed(rows, name, seed=SEED)
        injected[name] = raw.count() / rows.count() - 1
        raw = raw.withColumn("_ord", F.monotonically_increasing_id())
        got = cleaning.clean(raw, name, stage=True)
        cleaned[name] = got
    assert 0.01 < injected["sales"] < 0.02 and injected["inventory"] == 0
    return plants, cleaned


def test_dirt_is_found_and_counted(world):
    _, cleaned = world
    counts = cleaned["sales"].counts.first()
    # equal sales of one day and region are copies of each other too, as far as text can tell
    assert counts["duplicates_removed"] / counts["total_raw_rows"] > 0.01
    assert 0.005 < counts["rows_dropped"] / counts["total_raw_rows"] < 0.02
    assert counts["clean_rows"] == cleaned["sales"].rows.count()


def test_feeds_fit_together(world):
    _, cleaned = world
    rows = {n: c.rows for n, c in cleaned.items()}
    checks = crossref.cross_reference(rows["sales"], rows["orders"], rows["inventory"], rows["returns"]).collect()
    assert [r["clean"] for r in checks] == [True, True, True]


def test_planted_anomalies_are_recalled(world):
    plants, cleaned = world
    sales, returns = cleaned["sales"].rows, cleaned["returns"].rows
    found = {(r["dimension_value"], r["period"], r["direction"]) for r in an.detect_anomalies(sales, returns).collect()}
    assert ("East", "2026-01", "below") in found
    assert ("SKU-111", "2025-11-23", "above") in found or ("SKU-111", "2025-11-16", "above") in found
    assert ("SKU-107", "2026-02-08", "above") in found
    assert ("SKU-104", "2026-03", "above") in found


def test_report_end_to_end(world, tmp_path):
    _, cleaned = world
    feeds = {n: c.rows for n, c in cleaned.items()}
    report = rp.build_report(feeds)
    labels = report["labels"].first()
    # no currency column: the only currency is the placeholder, so nothing is scoped
    assert labels["effective_currency"] is None and labels["period_label"] == "Jun 2026"
    assert report["kpis"].count() == 5 and report["revenue_trend"].count() == 15
    assert "currency_breakdown" not in report
    risks = report["risks"].collect()
    assert any("Product 16" in r["title"] for r in report["inventory_health"].selectExpr("label as title").collect())
    assert 0 < len(risks) <= 6
    current = report["performers_sku"].agg(F.sum("current")).first()[0]
    revenue = report["kpis"].filter("kpi = 'revenue'").first()["current"]
    assert current == pytest.approx(revenue)


def _tiny(spark):
    sales = spark.createDataFrame([
        (D(2025, 1, 5), "a", "N", "Web", 1.0, 10.0, "USD", 0), (D(2025, 2, 5), "a", "N", "Web", 2.0, 20.0, "USD", 1),
        (D(2025, 2, 6), "b", "S", "Shop", 1.0, 7.0, "USD", 2), (D(2025, 1, 6), "b", "S", "Shop", 1.0, 5.0, "EUR", 3)],
        "date date, sku string, region string, channel string, units double, revenue double, currency string, _ord bigint")
    return {"sales": sales.withColumn("revenue", F.col("revenue").cast("decimal(18,4)"))}


def test_currency_is_judged_on_history_unless_told_otherwise(spark):
    feeds = _tiny(spark)
    history = rp.resolve_scope(feeds, rp.ReportScope())
    assert (history.several_currencies, history.currency) == (True, "USD")
    display = rp.resolve_scope(feeds, rp.ReportScope(currency_scope="display"))
    assert (display.several_currencies, display.currency) == (False, None)


def test_currency_note_names_what_was_judged(spark):
    """Euros in January, dollars in February: the note and the breakdown cover the history that was judged."""
    report = rp.build_report(_tiny(spark), rp.ReportScope())
    assert [r["currency"] for r in report["judged_currencies"].collect()] == ["EUR", "USD"]
    assert {r["currency"] for r in report["currency_breakdown"].collect()} == {"EUR", "USD"}
    text = rp.export_tables(report, _tiny(spark))["summary"].filter("item = 'Currency scope'").first()["text"]
    assert "EUR, USD" in text


def test_margin_needs_a_mapped_cost(spark):
    raw = spark.createDataFrame([("a", "W", "5", "2", 0)], "SKU string, Warehouse string, `On Hand` string, `Reorder Pt` string, _ord bigint")
    stock = cleaning.clean(raw, "inventory")
    assert stock.mapping["unitCost"] is None
    for feed, known in ((stock, False), (stock.rows, True)):
        row = rp.build_report(_tiny(spark) | {"inventory": feed})["kpis"].filter("kpi = 'avgMargin'").first()
        assert (row["current"] is not None) == known and (row["caveat"] == rp.MARGIN_CAVEAT) == (not known)


def test_channel_only_counts_if_present_in_range(spark):
    feeds = _tiny(spark)
    assert rp.resolve_scope(feeds, rp.ReportScope(channel="Shop")).channel == "Shop"
    assert rp.resolve_scope(feeds, rp.ReportScope(channel="Kiosk")).channel is None
    january = (D(2025, 1, 1), D(2025, 1, 5))
    assert rp.resolve_scope(feeds, rp.ReportScope(span=january, channel="Shop")).channel is None


def test_blanks_explain_themselves(spark):
    kpis = {r["kpi"]: r for r in rp.build_report(_tiny(spark))["kpis"].collect()}
    assert kpis["avgMargin"]["caveat"] == rp.MARGIN_CAVEAT and kpis["orders"]["caveat"] == rp.ORDERS_CAVEAT
    assert kpis["returnRate"]["caveat"] == rp.RETURNS_CAVEAT and kpis["revenue"]["caveat"] is None
    assert kpis["revenue"]["current"] == 27.0 and kpis["revenue"]["polarity"] == "good"


def test_export_and_context(spark):
    feeds = _tiny(spark)
    report = rp.build_report(feeds, rp.ReportScope(channel="Web"))
    summary = responses.coerce_summaries(spark.createDataFrame([(json.dumps({
        "headline": "Up", "sections": [{"heading": "What", "bullets": ["one", "two"]}],
        "recommendations": [{"title": "Restock", "detail": "now"}]}),)], "r string"), "r")
    tables = rp.export_tables(report, feeds, ["Restock"], ["Sale in May"], summary, dt.datetime(2025, 3, 1, 9, 30))
    lines = {r["item"]: r["text"] for r in tables["summary"].collect()}
    assert lines["Reporting period"] == "Feb 2025" and lines["Headline"] == "Up"
    assert lines["Generated"] == "Mar 1, 2025, 9:30 AM" and lines["Business context"] == "Sale in May"
    # the Web channel sells in one currency
    assert "Currency scope" not in lines
    assert lines["Channel scope"].startswith('Filtered to the "Web" channel only.')
    assert [r["bullet"] for r in tables["sections"].orderBy("bullet_no").collect()] == ["one", "two"]
    assert tables["recommendations"].first()["actioned"] is True
    top = tables["top_performers"].first()
    assert (top["dimension_value"], top["revenue"], top["trend"]) == ("a", "$20", "+100.0% MoM")
    document = json.loads(rp.report_context(report, [str(i) for i in range(10)], ["n"]).first()["context"])
    assert document["periodLabel"] == "Feb 2025" and document["actionedRecommendations"] == [str(i) for i in range(2, 10)]
    assert document["topPerformers"] == [{"dimension": "SKU", "label": "a", "revenue": "$20", "trend": "+100.0% MoM"}]
    assert [k["label"] for k in document["kpis"]][:2] == ["Total revenue", "Units sold"]
    assert document["contextNotes"] == ["n"] and document["topAnomalies"] == []


def test_currency_note_names_all_currencies(spark):
    feeds = _tiny(spark)
    tables = rp.export_tables(rp.build_report(feeds, rp.ReportScope(span=(D(2025, 1, 1), D(2025, 2, 28)))), feeds)
    lines = {r["item"]: r["text"] for r in tables["summary"].collect()}
    assert "(EUR, USD). All monetary figures in this report are scoped to USD only" in lines["Currency scope"]
    assert lines["Headline"] == rp.NO_SUMMARY


def test_range_report_has_no_trend_columns_but_a_comparison(spark):
    report = rp.build_report(_tiny(spark), rp.ReportScope(span=(D(2025, 2, 1), D(2025, 2, 28))))
    labels = report["labels"].first()
    assert (labels["period_label"], labels["comparison_label"]) == ("Feb 1, 2025 – Feb 28, 2025", "vs. prior period")
    revenue = report["kpis"].filter("kpi = 'revenue'").first()
    assert revenue["mom"] == pytest.approx(1.7) and revenue["qoq"] is None
    marks = {r["month"]: r["highlighted"] for r in report["trend_markers"].collect()}
    assert marks == {"2025-01": False, "2025-02": True}


RESPONSES = [
    ({"headline": "H", "sections": [{"heading": "A", "bullets": ["x", " ", 3]}, {"heading": 5, "bullets": ["y"]}, "text"],
      "recommendations": [{"title": "t", "detail": "d"}, {"title": "t"}]}, ("H", [("A", ["x"])], [("t", "d", "")], True)),
    ({"headline": "H", "sections": json.dumps([{"heading": "A", "bullets": json.dumps(["x", "y"])}]),
      "recommendations": json.dumps([{"title": "t", "detail": "d", "relatedKpi": "revenue"}])},
     ("H", [("A", ["x", "y"])], [("t", "d", "revenue")], True)),
    ({"headline": 4, "sections": "[{broken", "recommendations": None}, ("", [], [], False)),
    ({"headline": "H", "sections": [{"heading": "A", "bullets": [" "]}], "recommendations": [{"detail": "d"}]},
     ("H", [], [], False)),
    ([1, 2], ("", [], [], False)),
    ("text", ("", [], [], False)),
]


def test_responses(spark):
    rows = [(i, json.dumps(r)) for i, (r, _) in enumerate(RESPONSES)] + [(99, "{broken"), (100, None)]
    got = responses.coerce_summaries(spark.createDataFrame(rows, "i int, r string"), "r")
    plain = [(r["headline"], [(s["heading"], s["bullets"]) for s in r["sections"]],
              [(x["title"], x["detail"], x["relatedKpi"]) for x in r["recommendations"]], r["usable"])
             for r in got.orderBy("i").collect()]
    assert plain == [want for _, want in RESPONSES] + [("", [], [], False)] * 2
    assert responses.usable_summaries(got).count() == 2 and responses.rejected_summaries(got).count() == 6


def test_note_lines(spark):
    df = spark.createDataFrame([(1, "- Prime Day\n\n2) Sale\n   \nplain")], "k int, t string")
    got = responses.note_lines(df, "t", ["k"]).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in got] == [(0, "Prime Day"), (2, "Sale"), (4, "plain")]


def test_synthetic_rows_repeat(spark):
    products = spark.range(3).select(F.col("id").alias("pick"), F.col("id").cast("string").alias("sku"),
                                     F.lit("n").alias("name"), F.lit(5).alias("price"), F.lit(2).alias("cost"))
    regions = spark.createDataFrame([("N", 1.0)], "region string, weight double")
    both = [synthetic.sales_lines(products.repartition(n), regions, D(2025, 1, 1), D(2025, 1, 20)) for n in (1, 7)]
    assert both[0].exceptAll(both[1]).count() == 0 and both[0].count() == both[1].count()
