"""Registered queries: every operator applied to the whole star-schema tables."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, fmt
from ..operators import anomalies as an
from ..operators import cleaning, crossref, currency, kpi, mapping, performers, ranges, responses, risks, scoping
from ..operators.fold import staged_folds
from ..sources import feeds, sinks, star, synthetic
from ..spark_tools import scratch_path
from . import report
from .rawfeeds import header_catalogue, raw_feed

Query = Callable[[SparkSession, str], DataFrame]
CURRENCY = ("currency",)
# a custom reporting range that is not aligned to months
SPAN = (dt.date(2001, 2, 10), dt.date(2001, 5, 20))

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Ratios at report precision, so that two engines print the same digits."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---- KPIs -----------------------------------------------------------------------------------------------------------

def _kpi_inputs(spark: SparkSession, sf_dir: str):
    return (
        star.sales(spark, sf_dir, ["date", "sku", "units", "revenue", "currency"]),
        star.orders(spark, sf_dir, ["orderDate", "currency"]),
        star.returns(spark, sf_dir, ["returnDate", "units", "currency"]),
        star.unit_costs(spark, sf_dir),
    )


@query
def kpi_snapshot(spark, sf_dir):
    df = kpi.kpi_snapshot(*_kpi_inputs(spark, sf_dir), by=CURRENCY)
    return _rounded(df, "returnRate", "avgMargin", "costedRevenueShare")


def _kpi_rows(df: DataFrame) -> DataFrame:
    return _rounded(df, "current", "mom", "qoq", "yoy").select("currency", "anchor_month", "kpi", "label", "format", "current", "mom", "qoq", "yoy")


@query
def kpi_trend(spark, sf_dir):
    return _kpi_rows(kpi.kpi_trend(*_kpi_inputs(spark, sf_dir), by=CURRENCY))


@query
def kpi_range_trend(spark, sf_dir):
    return _kpi_rows(kpi.kpi_range_trend(*_kpi_inputs(spark, sf_dir), SPAN, by=CURRENCY))


@query
def monthly_revenue(spark, sf_dir):
    return kpi.monthly_revenue(star.sales(spark, sf_dir, ["date", "revenue", "currency"]), CURRENCY)


# ---- performers -----------------------------------------------------------------------------------------------------

def _performer_sales(spark: SparkSession, sf_dir: str, dim: str) -> DataFrame:
    return star.sales(spark, sf_dir, ["date", dim, "revenue", "currency"])


def _latest(spark: SparkSession, sf_dir: str, dim: str) -> DataFrame:
    ranked = performers.performers_latest_month(_performer_sales(spark, sf_dir, dim), dim, CURRENCY)
    return _rounded(performers.ranked_performers(ranked, CURRENCY), "delta_pct")


@query
def performers_sku_month(spark, sf_dir):
    return _latest(spark, sf_dir, "sku")


@query
def performers_region_month(spark, sf_dir):
    return _latest(spark, sf_dir, "region")


@query
def performers_channel_month(spark, sf_dir):
    return _latest(spark, sf_dir, "channel")


def _range_skus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return performers.performers_in_range(_performer_sales(spark, sf_dir, "sku"), "sku", SPAN, CURRENCY)


@query
def performers_sku_range(spark, sf_dir):
    return _rounded(performers.ranked_performers(_range_skus(spark, sf_dir), CURRENCY), "delta_pct")


@query
def top_bottom_sku(spark, sf_dir):
    """Ten best and ten worst SKUs of each currency in the range."""
    return _rounded(performers.top_bottom(_range_skus(spark, sf_dir), 10, CURRENCY), "delta_pct")


@query
def top_bottom_by_currency(spark, sf_dir):
    return _rounded(performers.top_bottom(_range_skus(spark, sf_dir), by=CURRENCY), "delta_pct")


# ---- currencies and channels ----------------------------------------------------------------------------------------

@query
def currency_breakdown(spark, sf_dir):
    return currency.currency_breakdown(
        star.sales(spark, sf_dir, ["revenue", "units", "currency"]), star.orders(spark, sf_dir, ["currency"]),
        star.returns(spark, sf_dir, ["refund", "currency"]))


def _by_currency(spark: SparkSession, sf_dir: str, dim: str) -> DataFrame:
    return currency.dimension_by_currency(star.sales(spark, sf_dir, [dim, "revenue", "currency"]), dim)


@query
def revenue_by_region_currency(spark, sf_dir):
    return _by_currency(spark, sf_dir, "region")


@query
def revenue_by_channel_currency(spark, sf_dir):
    return _by_currency(spark, sf_dir, "channel")


@query
def revenue_by_sku_currency(spark, sf_dir):
    return _by_currency(spark, sf_dir, "sku")


@query
def category_cut(spark, sf_dir):
    """Six best SKUs of each currency in the range."""
    return performers.category_cut(_range_skus(spark, sf_dir), by=CURRENCY).select(
        "currency", "rank", "dimension_value", "current")


@query
def category_cut_by_currency(spark, sf_dir):
    return performers.category_cut(_by_currency(spark, sf_dir, "sku"), 5, CURRENCY).drop("group_total")


@query
def available_currencies(spark, sf_dir):
    return currency.available_currencies(
        *(feed(spark, sf_dir, ["currency"]) for feed in (star.sales, star.orders, star.returns)))


@query
def default_currency(spark, sf_dir):
    return currency.default_currency(star.sales(spark, sf_dir, ["currency"], order=True))


@query
def available_channels(spark, sf_dir):
    return performers.available_channels(star.sales(spark, sf_dir, ["channel"]), star.orders(spark, sf_dir, ["channel"]))


# ---- series and anomalies -------------------------------------------------------------------------------------------

_FLOATS = ("observed", "baseline", "deviation")


def _unit_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.sales(spark, sf_dir, ["date", "sku", "units"])


def _unit_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return star.returns(spark, sf_dir, ["returnDate", "sku", "units"])


@query
def sku_week_buckets(spark, sf_dir):
    buckets = an.sku_week_units(_unit_sales(spark, sf_dir))
    return buckets.select("dimension_value", F.col("start").cast("string").alias("period"), "value", "n_rows")


@query
def sku_units_zscore(spark, sf_dir):
    return _rounded(an.sku_unit_anomalies(_unit_sales(spark, sf_dir), "zscore", 2.5), *_FLOATS)


@query
def sku_units_iqr(spark, sf_dir):
    return _rounded(an.sku_unit_anomalies(_unit_sales(spark, sf_dir), "iqr", 1.5), *_FLOATS)


@query
def sku_returns_zscore(spark, sf_dir):
    return _rounded(an.sku_return_anomalies(_unit_returns(spark, sf_dir), "zscore", 2.5), *_FLOATS)


@query
def sku_returns_iqr(spark, sf_dir):
    return _rounded(an.sku_return_anomalies(_unit_returns(spark, sf_dir), "iqr", 1.5), *_FLOATS)


@query
def region_rolling_baseline(spark, sf_dir):
    sales = star.sales(spark, sf_dir, ["date", "region", "revenue", "currency"])
    return _rounded(an.region_revenue_anomalies(sales, 0.25, by=CURRENCY), *_FLOATS)


# ---- key reconciliation ---------------------------------------------------------------------------------------------

@query
def xref_report(spark, sf_dir):
    """All checks over whole feeds in which the stock list and the returns spell some keys in a way of their own."""
    return crossref.cross_reference(
        star.sales(spark, sf_dir, ["sku"]), star.orders(spark, sf_dir, ["orderId"]),
        _respelt(star.inventory(spark, sf_dir, ["sku"]), "sku", "0"),
        _respelt(_respelt(star.returns(spark, sf_dir, ["orderId", "sku"]), "orderId", "7"), "sku", "99"))


def _respelt(feed: DataFrame, key: str, ending: str) -> DataFrame:
    return feed.withColumn(key, F.when(F.col(key).endswith(ending), F.concat(F.lit("X"), F.col(key))).otherwise(F.col(key)))


def _clean(spark: SparkSession, sf_dir: str, dataset: str) -> DataFrame:
    """The whole cleaned feed; its dirt leaves keys that the other feeds lack."""
    return cleaning.clean(raw_feed(spark, sf_dir, dataset), dataset).rows


@query
def xref_sales_inventory(spark, sf_dir):
    return crossref.unmatched_keys(_clean(spark, sf_dir, "sales"), _clean(spark, sf_dir, "inventory"), "sku")


@query
def xref_returns_orders(spark, sf_dir):
    return crossref.unmatched_keys(_clean(spark, sf_dir, "returns"), _clean(spark, sf_dir, "orders"), "orderId")


@query
def xref_returns_sales(spark, sf_dir):
    return crossref.match_counts(_clean(spark, sf_dir, "returns"), _clean(spark, sf_dir, "sales"), "sku")


# ---- the whole way from raw feeds -----------------------------------------------------------------------------------

@query
def clean_currency_breakdown(spark, sf_dir):
    """Currencies of the cleaned feeds: lower case, blanks and placeholders as they come."""
    return currency.currency_breakdown(*(_clean(spark, sf_dir, d) for d in ("sales", "orders", "returns")))


@query
def clean_dimension_by_currency(spark, sf_dir):
    return currency.dimension_by_currency(_clean(spark, sf_dir, "sales"), "region")


# ---- ranking, scoping and drill-down of anomalies -------------------------------------------------------------------

def _folds(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sales and returns folded by day, each scanned once for all tables made of them."""
    sales = star.sales(spark, sf_dir, ["date", "sku", "region", "units", "revenue", "currency"])
    returns = star.returns(spark, sf_dir, ["returnDate", "sku", "units", "currency"])
    folds = staged_folds({"sales": sales, "returns": returns})
    return folds["sales"], folds["returns"]


def _currency_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All detectors at standard sensitivity within each currency."""
    return an.detect_anomalies(*_folds(spark, sf_dir), by=CURRENCY)


@query
def anomalies_ranked(spark, sf_dir):
    return _rounded(an.ranked(_currency_anomalies(spark, sf_dir)), *_FLOATS).drop("detector_ord")


@query
def anomalies_in_range(spark, sf_dir):
    return _rounded(an.overlapping(_currency_anomalies(spark, sf_dir), SPAN), *_FLOATS).drop("detector_ord")


@query
def anomalies_all_presets(spark, sf_dir):
    """Every sensitivity of every detector, each series scored once."""
    sales = star.sales(spark, sf_dir, ["date", "sku", "units"])
    regional = star.sales(spark, sf_dir, ["date", "region", "revenue", "currency"])
    weeks = an.sku_week_units(sales)
    z = an.zscore_outliers(weeks, an.THRESHOLDS["zscore"], "sku", "week", an.WEEKLY_UNITS)
    q = an.iqr_outliers(weeks, an.THRESHOLDS["iqr"], "sku", "week", an.WEEKLY_UNITS)
    r = an.region_revenue_anomalies(regional, an.THRESHOLDS["rolling-baseline"], by=CURRENCY)
    back = _unit_returns(spark, sf_dir)
    for found in (z, q, *(an.sku_return_anomalies(back, m, an.THRESHOLDS[m]) for m in ("zscore", "iqr"))):
        r = r.unionByName(found, allowMissingColumns=True)
    return _rounded(r, *_FLOATS)


def _strongest_weeks(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = an.sku_unit_anomalies(_unit_sales(spark, sf_dir), "zscore", 2.5).withColumn("detector_ord", F.lit(0))
    return an.strongest(found, 12)


@query
def anomalies_strongest(spark, sf_dir):
    return _rounded(_strongest_weeks(spark, sf_dir), *_FLOATS).select("rank", "id", "deviation", "severity")


@query
def anomaly_drilldown(spark, sf_dir):
    source = star.sales(spark, sf_dir, ["date", "sku", "channel", "units", "revenue"], order=True)
    return an.drill_down(source, "date", "week", "sku", _strongest_weeks(spark, sf_dir),
                         ["date", "sku", "channel", "units", "revenue"])


@query
def trend_with_markers(spark, sf_dir):
    sales = star.sales(spark, sf_dir, ["date", "region", "revenue", "currency"])
    marks = an.region_revenue_anomalies(sales, 0.25, by=CURRENCY)
    trend = an.trend_with_markers(kpi.monthly_revenue(sales, CURRENCY), marks, SPAN, CURRENCY)
    return _rounded(trend, "anomaly_deviation")


@query
def anomaly_pick_by_metric(spark, sf_dir):
    picked = an.pick_by_metric(_currency_anomalies(spark, sf_dir), CURRENCY)
    return _rounded(picked, *_FLOATS).select("currency", "pick", "metric_label", "id", "deviation")


# ---- ranges and scope filters ---------------------------------------------------------------------------------------

@query
def date_bounds(spark, sf_dir):
    return ranges.date_bounds(star.sales(spark, sf_dir, ["date"]))


@query
def range_presets(spark, sf_dir):
    return ranges.range_presets(ranges.date_bounds(star.sales(spark, sf_dir, ["date"])))


@query
def scoped_sales(spark, sf_dir):
    sales = star.sales(spark, sf_dir)
    return scoping.in_currency(scoping.in_channel(scoping.in_range(sales, "date", SPAN), "1-URGENT"), "INR")


@query
def sales_in_quarter(spark, sf_dir):
    sales = star.sales(spark, sf_dir, ["date", "sku", "region", "units", "currency"])
    return scoping.in_quarter(sales, "date", dt.date(2000, 8, 1))


@query
def period_keys(spark, sf_dir):
    """Calendar keys and neighbours of every sales day, with the rows that fall on it."""
    d = F.col("date")
    month, quarter = dates.month_start(d), dates.quarter_start(d)
    before = dates.previous_range(month, d)
    return star.sales(spark, sf_dir, ["date"]).groupBy("date").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "date", "n_rows", dates.month_key(d).alias("month"), dates.quarter_key(d).alias("quarter"),
        dates.week_key(d).alias("week"), dates.month_end(d).alias("month_end"),
        dates.month_key(dates.shift_month(month, -1)).alias("month_before"),
        dates.quarter_key(dates.shift_quarter(quarter, -1)).alias("quarter_before"),
        before[0].alias("previous_start"), before[1].alias("previous_end"),
        dates.month_label(d).alias("month_label"), dates.range_label(month, d).alias("range_label"))


# ---- inventory and risks --------------------------------------------------------------------------------------------

@query
def inventory_risk(spark, sf_dir):
    return risks.inventory_risk(star.inventory(spark, sf_dir, order=True)).drop("_ord")


@query
def inventory_worst_gaps(spark, sf_dir):
    return risks.worst_gaps(star.inventory(spark, sf_dir, order=True)).drop("_ord")


@query
def stockout_risks(spark, sf_dir):
    return risks.stockout_risks(star.inventory(spark, sf_dir, order=True))


@query
def risk_flags(spark, sf_dir):
    """The list of each currency, and the stockouts, which belong to none."""
    sales, returns = _folds(spark, sf_dir)
    return risks.risk_flags(
        star.inventory(spark, sf_dir, order=True), performers.performers_latest_month(sales, "sku", CURRENCY),
        performers.performers_latest_month(sales, "region", CURRENCY), an.detect_anomalies(sales, returns, by=CURRENCY),
        by=CURRENCY)


@query
def risk_rules(spark, sf_dir):
    """The rules behind the stockouts, per currency and against the range before."""
    sales, returns = _folds(spark, sf_dir)
    growth = risks.growth_opportunity(performers.performers_in_range(sales, "sku", SPAN, CURRENCY), CURRENCY)
    decline = risks.declining_region(performers.performers_latest_month(sales, "region", CURRENCY), CURRENCY)
    flags = risks.high_anomaly_flags(an.detect_anomalies(sales, returns, by=CURRENCY), by=CURRENCY).drop("within_ord")
    return growth.unionByName(decline).unionByName(flags)


# ---- cleaning -------------------------------------------------------------------------------------------------------

@query
def clean_sales(spark, sf_dir):
    return cleaning.clean(raw_feed(spark, sf_dir, "sales"), "sales").rows


@query
def clean_orders(spark, sf_dir):
    return cleaning.clean(raw_feed(spark, sf_dir, "orders"), "orders").rows


@query
def clean_inventory(spark, sf_dir):
    return cleaning.clean(raw_feed(spark, sf_dir, "inventory"), "inventory").rows


@query
def clean_returns(spark, sf_dir):
    return cleaning.clean(raw_feed(spark, sf_dir, "returns"), "returns").rows


@query
def clean_sales_counts(spark, sf_dir):
    return cleaning.clean(raw_feed(spark, sf_dir, "sales"), "sales").counts


@query
def cleaning_totals(spark, sf_dir):
    return cleaning.cleaning_totals(
        *(cleaning.clean(raw_feed(spark, sf_dir, d), d).counts for d in ("sales", "orders", "inventory", "returns")))


@query
def dedupe_count(spark, sf_dir):
    return cleaning.duplicates_removed(raw_feed(spark, sf_dir, "sales"))


@query
def required_blank_warning(spark, sf_dir):
    deduped = cleaning.dedupe(raw_feed(spark, sf_dir, "sales"))
    mapping = {"date": "Date", "sku": "SKU", "units": "Qty", "revenue": "Revenue"}
    return cleaning.required_blank_warning(deduped, "sales", mapping, sample=None)


@query
def required_blank_sample(spark, sf_dir):
    deduped = cleaning.dedupe(raw_feed(spark, sf_dir, "orders"))
    mapping = {"orderId": "OrderID", "orderDate": "Order Date", "total": "Total"}
    return cleaning.required_blank_warning(deduped, "orders", mapping, sample=200)


@query
def feed_roundtrip(spark, sf_dir):
    """The raw sales feed written as CSV and read back as text."""
    path = scratch_path(spark, "feed") + ".csv"
    sinks.write_table(raw_feed(spark, sf_dir, "sales", order=False), path, "csv")
    return feeds.read_feed(spark, path).drop("_ord")


@query
def feed_line_breaks(spark, sf_dir):
    """The raw sales feed with line breaks, quotes and commas inside cells, written as CSV and read back by split."""
    raw = raw_feed(spark, sf_dir, "sales", order=False)
    broken = F.concat("Product", F.lit('\n"'), "Region", F.lit('",\n'), "Channel")
    raw = raw.withColumn("Product", F.when(F.col("Qty").endswith("1"), broken).otherwise(F.col("Product")))
    path = scratch_path(spark, "feed") + ".csv"
    sinks.write_table(raw, path, "csv")
    return feeds.read_feed(spark, path).drop("_ord")


# ---- header mapping -------------------------------------------------------------------------------------------------

@query
def header_candidates(spark, sf_dir):
    catalogue = header_catalogue(spark, sf_dir)
    distinct = catalogue.groupBy("feed", "dataset", "header").agg(F.min("header_ord").alias("header_ord"))
    return _rounded(mapping.header_candidates(distinct), "score")


@query
def header_mapping(spark, sf_dir):
    return mapping.assign_headers(header_catalogue(spark, sf_dir))


def _pins(catalogue: DataFrame) -> DataFrame:
    """Every third feed pins its SKU to its first header; every fifth clears its currency."""
    feed = F.col("feed").cast("bigint")
    first = catalogue.filter(F.col("header_ord") == 0)
    pinned = first.filter(feed % 3 == 0).select("feed", F.lit("sku").alias("field"), "header")
    cleared = first.filter(feed % 5 == 0).select("feed", F.lit("currency").alias("field"),
                                                 F.lit(None).cast("string").alias("header"))
    return pinned.unionByName(cleared)


@query
def header_mapping_pinned(spark, sf_dir):
    catalogue = header_catalogue(spark, sf_dir)
    return mapping.assign_headers(catalogue, _pins(catalogue))


@query
def mapping_report(spark, sf_dir):
    catalogue = header_catalogue(spark, sf_dir)
    return mapping.mapping_report(catalogue, mapping.assign_headers(catalogue))


@query
def override_diff(spark, sf_dir):
    catalogue = header_catalogue(spark, sf_dir)
    return mapping.override_diff(mapping.assign_headers(catalogue), mapping.assign_headers(catalogue, _pins(catalogue)))


# ---- text -----------------------------------------------------------------------------------------------------------

@query
def note_lines(spark, sf_dir):
    return responses.note_lines(star.table(spark, sf_dir, "documents"), "text", ["doc_id"])


def _stored_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON response per document, in turn well-formed, double-encoded, with broken parts, or not an object."""
    lines = F.split("text", "\n")
    bullets = F.concat(lines, F.array(F.lit("  ")))
    head = F.concat(F.lit("About "), F.col("source"))
    sections = F.array(F.struct(F.lit("Findings").alias("heading"), bullets.alias("bullets")),
                       F.struct(F.lit("Blank").alias("heading"), F.array(F.lit(" ")).alias("bullets")))
    encoded = F.array(F.struct(F.lit("Findings").alias("heading"), F.to_json(bullets).alias("bullets")))
    advice = F.array(F.struct(F.col("lang").alias("title"), F.element_at(lines, 1).alias("detail"),
                              F.when(F.col("doc_id") % 2 == 0, "revenue").alias("relatedKpi")))
    untitled = F.array(F.struct(F.lit("no title").alias("detail")))
    kind = F.col("doc_id") % 7

    def doc(s, r, h=head):
        return F.to_json(F.struct(h.alias("headline"), s.alias("sections"), r.alias("recommendations")))

    response = (
        F.when(kind == 0, doc(sections, advice)).when(kind == 1, doc(F.to_json(sections), F.to_json(advice)))
        .when(kind == 2, doc(encoded, advice)).when(kind == 3, doc(F.lit("[{broken"), advice))
        .when(kind == 4, doc(sections, untitled)).when(kind == 5, doc(sections, advice, F.lit(7)))
        .otherwise(F.to_json(lines))
    )
    return star.table(spark, sf_dir, "documents").select("doc_id", response.alias("response"))


@query
def summary_coercion(spark, sf_dir):
    found = responses.coerce_summaries(_stored_responses(spark, sf_dir), "response")
    size = F.aggregate("sections", F.lit(0), lambda n, s: n + F.size(s["bullets"]))
    chars = F.aggregate("sections", F.lit(0).cast("bigint"), lambda n, s: n + F.aggregate(
        s["bullets"], F.lit(0).cast("bigint"), lambda m, b: m + F.length(b)))
    first = F.get("recommendations", F.lit(0))
    return found.select("doc_id", "headline", F.size("sections").alias("n_sections"), size.alias("n_bullets"),
                        chars.alias("bullet_chars"), F.size("recommendations").alias("n_recommendations"),
                        first["title"].alias("title"), first["detail"].alias("detail"),
                        first["relatedKpi"].alias("related_kpi"), "usable")


# ---- formatted tables, whole reports, synthetic feeds ---------------------------------------------------------------

@query
def kpi_formatted(spark, sf_dir):
    """KPI cards as printed, with caveat and polarity, each amount in its own currency."""
    rows = report.kpi_captions(kpi.kpi_trend(*_kpi_inputs(spark, sf_dir), by=CURRENCY), True, True, True, None)
    return report.format_kpis(rows, F.col("currency")).select(
        "currency", "label", "current_text", "mom_text", "qoq_text", "yoy_text", "caveat", "polarity")


@query
def anomaly_captions(spark, sf_dir):
    """Deviation and method of every anomaly as printed."""
    return _currency_anomalies(spark, sf_dir).select(
        "currency", "id", fmt.format_deviation(F.col("method"), F.col("deviation")).alias("deviation_text"),
        fmt.format_method(F.col("method"), F.col("threshold")).alias("method_text"),
        fmt.format_number(F.col("observed")).alias("observed_text"),
        fmt.format_number(F.col("baseline")).alias("baseline_text"))


def _feeds(spark: SparkSession, sf_dir: str) -> report.Feeds:
    return {"sales": star.sales(spark, sf_dir, order=True), "orders": star.orders(spark, sf_dir, order=True),
            "inventory": star.inventory(spark, sf_dir, order=True), "returns": star.returns(spark, sf_dir, order=True)}


@query
def report_labels(spark, sf_dir):
    labels = report.build_report(_feeds(spark, sf_dir))["labels"]
    return labels.select("period_label", "comparison_label", "anchor_month", "effective_currency", "several_currencies")


@query
def report_channel_kpis(spark, sf_dir):
    """KPIs of a range under a channel and a chosen currency; the return rate is withheld."""
    scope = report.ReportScope(span=SPAN, channel="2-HIGH", currency="INR")
    kpis = report.build_report(_feeds(spark, sf_dir), scope)["kpis"]
    return _rounded(kpis, "current", "mom").select("kpi", "current", "mom", "caveat", "polarity")


@query
def report_open_range_kpis(spark, sf_dir):
    """KPIs of a range typed in without an end, against the equally long range before it."""
    scope = report.ReportScope(span=(SPAN[0], None), channel="2-HIGH", currency="INR")
    kpis = report.build_report(_feeds(spark, sf_dir), scope)["kpis"]
    return _rounded(kpis, "current", "mom").select("kpi", "current", "mom")


SCOPES = {
    "nothing picked": report.ReportScope(),
    "range, currencies of its display": report.ReportScope(span=SPAN, currency_scope="display"),
    "channel": report.ReportScope(channel="2-HIGH"),
    "range, channel and currency": report.ReportScope(span=SPAN, channel="2-HIGH", currency="INR"),
    "channel that does not occur": report.ReportScope(channel="none", currency="EUR"),
}


@query
def report_scopes(spark, sf_dir):
    """What some choices come to on the data: display range, channel, currency and latest month."""
    folds = staged_folds({n: df for n, df in _feeds(spark, sf_dir).items() if n != "inventory"})
    rows = [report.scope_row(folds, scope).select(F.lit(name).alias("scope"), "*") for name, scope in SCOPES.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


@query
def report_all_scopes(spark, sf_dir):
    """KPI cards of every currency and every channel within it."""
    kpis = report.report_all_scopes(_feeds(spark, sf_dir))["kpis"]
    return _rounded(kpis, "current", "mom", "qoq", "yoy").select(
        "currency", "channel", "anchor_month", "kpi", "current", "mom", "qoq", "yoy", "caveat", "polarity")


@query
def report_all_scopes_risks(spark, sf_dir):
    """Flags of every currency and every channel within it."""
    return report.report_all_scopes(_feeds(spark, sf_dir))["risks"]


@query
def report_context(spark, sf_dir):
    built = report.build_report(_feeds(spark, sf_dir), stage=True)
    return report.report_context(built, ["Restock the best seller"], ["Spring promotion in May"])


@query
def report_bundle(spark, sf_dir):
    """Every export table written out and counted from disk."""
    feeds_ = _feeds(spark, sf_dir)
    tables = report.export_tables(report.build_report(feeds_, stage=True), feeds_, notes=["Spring promotion in May"])
    written = sinks.write_bundle(tables, scratch_path(spark, "bundle"))
    counted = None
    for name, path in written.items():
        row = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("section"), "n_rows")
        counted = row if counted is None else counted.unionByName(row)
    return counted


@query
def export_cells(spark, sf_dir):
    """Cells of the export's sections, read back from a bundle in the folder of its reporting period."""
    feeds_ = {n: df for n, df in _feeds(spark, sf_dir).items()}
    built = report.build_report(feeds_, stage=True)
    tables = {n: df for n, df in report.export_tables(built, {}).items() if n in ("kpis", "risks", "top_performers", "bottom_performers")}
    path = sinks.bundle_path(scratch_path(spark, "export"), built["labels"].first()["period_label"])
    sinks.write_bundle(tables, path)
    cells = None
    for section, df in sinks.read_bundle(spark, path).items():
        number = "item" if section == "risks" else "row_no"
        rows = df.select(F.lit(section).alias("section"), F.col(number).cast("int").alias("row_no"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("cell"), F.col(c).cast("string").alias("text")) for c in df.columns if c != number])))
        cells = rows if cells is None else cells.unionByName(rows)
    return cells


def _catalogue(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = star.table(spark, sf_dir, "part")
    products = part.select(
        F.col("p_partkey").alias("pick"), F.col("p_partkey").cast("string").alias("sku"),
        F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"),
        (F.col("p_retailprice") * 0.6).alias("cost"))
    regions = star.table(spark, sf_dir, "region").select(
        F.col("r_name").alias("region"), (0.75 + 0.1 * F.col("r_regionkey")).alias("weight"))
    return products, regions


@query
def synthetic_volume(spark, sf_dir):
    """Lines per region and day of the generated feed, before the dirt."""
    products, regions = _catalogue(spark, sf_dir)
    lines = synthetic.sales_lines(products, regions, dt.date(2025, 4, 1), dt.date(2026, 6, 30), base=products.count() / 100)
    return lines.groupBy("region", "date").agg(F.count(F.lit(1)).alias("n_lines"))


@query
def synthetic_feed(spark, sf_dir):
    """A dirty sales feed over the table's own parts and regions, with volume in step with the number of parts."""
    products, regions = _catalogue(spark, sf_dir)
    lines = synthetic.sales_lines(products, regions, dt.date(2025, 4, 1), dt.date(2026, 6, 30),
                                  base=products.count() / 100)
    return synthetic.dirty_feed(lines, "sales")
