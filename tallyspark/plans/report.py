"""The whole report for one scope: resolve the scope, then hand out its tables as lazy DataFrames."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import month_label, month_start, range_label
from ..functions.fmt import (
    delta_polarity,
    format_currency,
    format_delta,
    format_deviation,
    format_kpi,
    format_method,
    format_number,
)
from ..operators import anomalies as an
from ..operators import currency as cur
from ..operators import kpi, performers, risks
from ..operators.cleaning import Cleaned
from ..operators.fold import ALL_CHANNELS, all_scopes, staged_folds
from ..operators.ranges import custom_range, date_bounds
from ..operators.ranking import top_k
from ..operators.scoping import DateRange, by_columns, in_channel, in_currency, in_range, row_weight
from ..sources.schema import DATASET_LABELS, DATE_COLUMN, ORD
from ..spark_tools import scratch_path

Feeds = dict[str, DataFrame | None]
Report = dict[str, DataFrame]

# Wording of the caveats, notes and fallbacks a report shows.
MARGIN_CAVEAT = 'Add a "Unit Cost" column to your Inventory upload to calculate margin.'
ORDERS_CAVEAT = "No Orders file was uploaded — this shows Sales-derived data only."
RETURNS_CAVEAT = "No Returns file was uploaded — this cannot be calculated."
CHANNEL_CAVEAT = (
    "Your Returns data isn't tagged by channel, so return rate can't be scoped to \"{0}\" — it would wrongly divide "
    "all-channel returns by one channel's units.")
NO_PRIOR_CAVEAT = "No prior-period data in your upload to compare against."
CURRENCY_NOTE = (
    "This data contains multiple currencies (", "). All monetary figures in this report are scoped to ",
    " only — amounts in other currencies are excluded, never blended in.")
CHANNEL_NOTE = (
    "Filtered to the \"{0}\" channel only. Return rate still reflects all channels combined — the Returns data in this "
    "upload has no channel field.")
NO_SUMMARY = "No executive summary has been generated yet — generate one on the Summary page first."
EXPORT_ANOMALIES, CONTEXT_ANOMALIES, CONTEXT_ACTIONS = 15, 8, 8
DEFAULT_CURRENCY = "USD"


@dataclass(frozen=True)
class ReportScope:
    """What the reader picked; nothing picked means calendar mode, all channels, the majority currency.

    ``span`` may be open at either end, where the data's own first or last day counts; a reversed range is no range.
    ``currency_scope`` says where several currencies are looked for: in the full ``history`` (so a single-currency latest
    month never blends an older mix) or only in the ``display`` range. ``include_unknown`` counts rows without a currency
    as one more currency.
    """

    span: tuple[dt.date | None, dt.date | None] | None = None
    channel: str | None = None
    currency: str | None = None
    currency_scope: str = "history"
    include_unknown: bool = True


@dataclass(frozen=True)
class ResolvedScope:
    bounds: DateRange | None
    display: DateRange | None
    channel: str | None
    currency: str | None
    several_currencies: bool
    anchor: dt.date | None


def _windowed(feeds: Feeds, span: DateRange | None, channel: str | None) -> Feeds:
    def cut(name: str) -> DataFrame | None:
        df = feeds.get(name)
        if df is None:
            return None
        df = in_range(df, DATE_COLUMN[name], span)
        return df if name == "returns" else in_channel(df, channel)

    return {name: cut(name) for name in ("sales", "orders", "returns")}


def with_closed_range(feeds: Feeds, scope: ReportScope) -> ReportScope:
    """``scope`` with a range as typed in closed at both ends; the data is asked for its bounds only if an end is open."""
    if scope.span is None:
        return scope
    bounds = scope.span
    if None in scope.span:
        row = date_bounds(feeds["sales"]).first()
        if row is None:
            return replace(scope, span=None)
        bounds = (row["start"], row["end"])
    return replace(scope, span=custom_range(*scope.span, bounds))


def resolve_scope(feeds: Feeds, scope: ReportScope) -> ResolvedScope:
    """Turns choices and data into literals that later filters can push into the scans; reads back one row."""
    row = scope_row(feeds, scope).first()
    return ResolvedScope(
        (row["data_start"], row["data_end"]) if row["data_end"] else None,
        (row["display_start"], row["display_end"]) if row["display_end"] else None,
        row["channel"], row["currency"], row["several_currencies"], row["anchor"])


def scope_row(feeds: Feeds, scope: ReportScope) -> DataFrame:
    """What ``scope`` comes to on the data, as one row: bounds, display range, channel, currency and latest month.

    Feeds or their folds are read once and folded to one row per currency code, feed and month with what a chosen channel
    leaves of it; that table, bounded by the codes and the calendar, is folded again per code and then as a whole. What
    depends on whether the chosen channel occurs is reckoned for both cases.
    """
    scope = with_closed_range(feeds, scope)
    parts = []
    for name, date in DATE_COLUMN.items():
        df = feeds.get(name)
        if df is None:
            continue
        mine = F.lit(True) if name == "returns" or not scope.channel else F.coalesce(F.col("channel") == scope.channel, F.lit(False))
        named = F.lit(scope.channel is not None and name != "returns") & mine
        parts.append(df.select(
            F.lit(name == "sales").alias("sale"), cur.currency_code(F.col("currency")).alias("code"), F.col(date).alias("day"),
            mine.alias("mine"), named.alias("named"), row_weight(df).alias("n"),
            (F.col(ORD) if ORD in df.columns else F.lit(None).cast("bigint")).alias("first")))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    span = [F.lit(d).cast("date") for d in scope.span] if scope.span else None
    month = F.col("day").between(*span).cast("int") if span else month_start(F.col("day"))
    keys = ["sale", "code", "mine", "named"]
    months = rows.groupBy(*keys, month.alias("at")).agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.min("day").alias("start"), F.max("day").alias("end"))
    sale = F.col("sale")
    bounds = months.agg(F.min(F.when(sale, F.col("start"))).alias("data_start"), F.max(F.when(sale, F.col("end"))).alias("data_end"))
    months = months.crossJoin(F.broadcast(bounds))  # one row
    shown = F.coalesce(F.col("at") == (F.lit(1) if span else month_start(F.col("data_end"))), F.lit(False))
    judged = shown if scope.currency_scope == "display" else F.lit(True)
    cases = {"all": F.lit(True), "own": F.col("mine")}
    codes = months.groupBy("code", "data_start", "data_end").agg(
        F.bool_or(shown & F.col("named")).alias("found"),
        *[c.alias(f"{k}_{case}") for case, ok in cases.items() for k, c in {
            "seen": F.bool_or(judged & ok), "n": F.sum(F.when(judged & ok & sale, F.col("n"))),
            "first": F.min(F.when(judged & ok & sale, F.col("first"))), "last": F.max(F.when(ok & sale, F.col("end")))}.items()])
    code = F.col("code")
    known = code.isNotNull() & (code != cur.NO_CURRENCY)
    counted = code.isNotNull() if scope.include_unknown else known
    wanted = F.lit(scope.currency).cast("string")
    whole = codes.agg(
        F.first("data_start").alias("data_start"), F.first("data_end").alias("data_end"), F.bool_or("found").alias("found"),
        *[c.alias(f"{k}_{case}") for case in cases for k, c in {
            "several": F.count_if(counted & F.col(f"seen_{case}")) > 1, "last": F.max(f"last_{case}"),
            "wanted_last": F.max(F.when(code == wanted, F.col(f"last_{case}"))),
            "major": F.min_by(F.struct("code", F.col(f"last_{case}").alias("last")), F.when(known & (F.col(f"n_{case}") > 0), F.struct(
                -F.col(f"n_{case}"), F.coalesce(F.col(f"first_{case}"), F.lit(2**63 - 1)), code)))}.items()])

    def case(k: str) -> Column:
        return F.when(F.col("found"), F.col(f"{k}_own")).otherwise(F.col(f"{k}_all"))

    several, major = F.coalesce(case("several"), F.lit(False)), case("major")
    currency = F.when(several, F.coalesce(wanted, major["code"]))
    last = F.when(~several, case("last")).when(wanted.isNotNull(), case("wanted_last")).when(
        major["code"].isNotNull(), major["last"]).otherwise(case("last"))
    start, end = span or (month_start(F.col("data_end")), F.last_day("data_end"))
    return whole.select(
        "data_start", "data_end", start.alias("display_start"), end.alias("display_end"),
        F.when(F.col("found"), F.lit(scope.channel).cast("string")).alias("channel"), currency.alias("currency"),
        several.alias("several_currencies"),
        (F.lit(None).cast("date") if span else month_start(last)).alias("anchor"))


def kpi_captions(rows: DataFrame, has_orders: bool, has_returns: bool, margin_known: bool,
                 channel: str | Column | None) -> DataFrame:
    """Blanks explain themselves: adds the first caveat that applies, and whether the delta is good or bad news.

    ``channel`` is the report's channel, or a column with every row's own (null for all channels).
    """
    k = F.col("kpi")
    caveat = F.when((k == "avgMargin") & F.lit(not margin_known), MARGIN_CAVEAT)
    # margin has no other caveat of its own, so it is decided before the rest are asked
    caveat = caveat.when((k == "avgMargin"), F.lit(None).cast("string"))
    caveat = caveat.when((k == "orders") & F.lit(not has_orders), ORDERS_CAVEAT)
    caveat = caveat.when((k == "returnRate") & F.lit(not has_returns), RETURNS_CAVEAT)
    if isinstance(channel, Column):
        before, after = CHANNEL_CAVEAT.split("{0}")
        caveat = caveat.when((k == "returnRate") & channel.isNotNull(), F.concat(F.lit(before), channel, F.lit(after)))
    elif channel:
        caveat = caveat.when(k == "returnRate", CHANNEL_CAVEAT.format(channel))
    caveat = caveat.when(F.col("mom").isNull(), NO_PRIOR_CAVEAT)
    return rows.withColumn("caveat", caveat).withColumn("polarity", delta_polarity(F.col("mom"), F.col("higher_is_better")))


def without_return_rate(rows: DataFrame, where: Column | None = None) -> DataFrame:
    """Returns carry no channel, so under a channel the return rate is withheld (in the rows of ``where``, or in all)."""
    hidden = F.col("kpi") == "returnRate"
    if where is not None:
        hidden = hidden & where
    return rows.withColumns({c: F.when(~hidden, F.col(c)) for c in ("current", "mom", "qoq", "yoy")})


def format_kpis(rows: DataFrame, code: Column) -> DataFrame:
    return rows.withColumns({
        "current_text": format_kpi(F.col("current"), F.col("format"), code),
        **{f"{c}_text": format_delta(F.col(c)) for c in ("mom", "qoq", "yoy")}})


def _staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared scratch folder and read back."""
    path = scratch_path(df.sparkSession, f"report-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def build_report(feeds: Feeds, scope: ReportScope = ReportScope(), method: str = "zscore",
                 sensitivity: str = "standard", unit_cost_mapped: bool | None = None, stage: bool = False) -> Report:
    """All report tables of one scope. Trend and anomalies use full history; KPIs and rankings the chosen range.

    Sales, orders and returns are folded by day first; the folds are the only readers of their rows, and one query over them
    settles the scope before anything is planned. Several tables are made of the same anomalies and rankings. With ``stage``
    those are written once to the shared scratch folder and read back as well.

    A feed may be given as ``Cleaned``; then the mapping tells whether a unit cost was mapped, and without one the margin is
    withheld. For a plain table it is ``unit_cost_mapped``, or whether the column is there.
    """
    if unit_cost_mapped is None:
        stock = feeds.get("inventory")
        unit_cost_mapped = (bool(stock.mapping.get("unitCost")) if isinstance(stock, Cleaned)
                            else stock is not None and "unitCost" in stock.columns)
    feeds = staged_folds({n: df.rows if isinstance(df, Cleaned) else df for n, df in feeds.items()})

    def shared(df: DataFrame, name: str) -> DataFrame:
        return _staged(df, name) if stage else df

    scope = with_closed_range(feeds, scope)
    where = resolve_scope(feeds, scope)
    span, channel = scope.span, where.channel
    full = _windowed(feeds, None, channel)
    full = {n: (in_currency(df, where.currency) if df is not None else None) for n, df in full.items()}
    sales, orders, returns, inventory = full["sales"], full["orders"], full["returns"], feeds.get("inventory")
    unit_cost = shared(kpi.unit_cost_by_sku(inventory), "unit-cost") if inventory is not None and unit_cost_mapped else None

    # ranges compare with the range before, so they are given full history as well
    kpis = (kpi.kpi_range_trend(sales, orders, returns, unit_cost, span) if span
            else kpi.kpi_trend(sales, orders, returns, unit_cost))
    if channel:
        kpis = without_return_rate(kpis)
    kpis = kpi_captions(kpis, orders is not None, returns is not None, unit_cost is not None, channel)

    kpis = shared(kpis, "kpis")
    found = shared(an.overlapping(an.detect_anomalies(sales, returns, method, sensitivity), span), "anomalies")
    ranking = {}
    for dim in ("sku", "region", "channel"):
        if span:
            ranking[dim] = performers.performers_in_range(sales, dim, span)
        else:
            ranking[dim] = performers.performers_in_month(sales, dim, where.anchor or dt.date(1970, 1, 1))
        ranking[dim] = shared(ranking[dim], f"performers-{dim}")

    visible = _windowed(feeds, where.display, channel)
    trend = shared(kpi.monthly_revenue(sales), "trend")
    report = {
        "bounds": date_bounds(feeds["sales"]),
        "kpis": kpis,
        "revenue_trend": trend,
        "trend_markers": an.trend_with_markers(trend, found, span),
        "anomalies": an.ranked(found),
        **{f"performers_{dim}": performers.ranked_performers(df) for dim, df in ranking.items()},
        "available_currencies": cur.available_currencies(*visible.values(), include_unknown=scope.include_unknown),
        "available_channels": performers.available_channels(
            *(_windowed(feeds, where.display, None)[n] for n in ("sales", "orders"))),
        "risks": risks.risk_flags(inventory, ranking["sku"], ranking["region"], found),
        "labels": _labels(feeds, scope, where, unit_cost is not None),
    }
    if inventory is not None:
        report["inventory_health"] = risks.inventory_risk(inventory)
    judged = visible if scope.currency_scope == "display" else _windowed(feeds, None, channel)
    report["judged_currencies"] = cur.available_currencies(*judged.values(), include_unknown=scope.include_unknown)
    if where.several_currencies:
        report["currency_breakdown"] = cur.currency_breakdown(judged["sales"], judged["orders"], judged["returns"])
        for dim in ("sku", "region", "channel"):
            report[f"revenue_by_currency_{dim}"] = cur.dimension_by_currency(judged["sales"], dim)
    return report


def report_all_scopes(feeds: Feeds, method: str = "zscore", sensitivity: str = "standard",
                      unit_cost_mapped: bool | None = None) -> Report:
    """The report of every currency and of every channel within it at once, each table keyed by (currency, channel).

    The channel ``*`` stands for all channels. Feeds are folded by day and the folds added up over their channels, so each
    feed is scanned once whatever the number of scopes. Every scope has its own latest month. Returns carry no channel: their anomalies are in
    every scope of their currency, and the return rate in those of all channels only. Stockouts belong to no scope.
    """
    stock = feeds.get("inventory")
    if unit_cost_mapped is None:
        unit_cost_mapped = (bool(stock.mapping.get("unitCost")) if isinstance(stock, Cleaned)
                            else stock is not None and "unitCost" in stock.columns)
    feeds = staged_folds({n: df.rows if isinstance(df, Cleaned) else df for n, df in feeds.items()})
    inventory = feeds.get("inventory")
    # counted first and then joined
    unit_cost = _staged(kpi.unit_cost_by_sku(inventory), "unit-cost") if inventory is not None and unit_cost_mapped else None
    scoped = staged_folds({n: df for n, df in feeds.items() if n in DATE_COLUMN}, all_scopes)
    sales, orders, returns = scoped["sales"], scoped.get("orders"), scoped.get("returns")
    by, one_channel = ("currency", "channel"), F.col("channel") != ALL_CHANNELS

    kpis = without_return_rate(kpi.kpi_trend(sales, orders, returns, unit_cost, by), one_channel)
    kpis = kpi_captions(kpis, orders is not None, returns is not None, unit_cost is not None,
                        F.when(one_channel, F.col("channel")))
    found = an.detect_anomalies(sales, None, method, sensitivity, by)
    if returns is not None:
        scopes = sales.select(*by_columns(sales, by)).distinct()
        level = an.THRESHOLDS[method][sensitivity]
        of_returns = an.sku_return_anomalies(returns, method, level, ("currency",)).withColumn("detector_ord", F.lit(1))
        found = found.unionByName(of_returns.join(scopes, "currency"))
    found = _staged(found, "anomalies")  # listed and cut for the flags
    ranking = {dim: performers.performers_latest_month(sales, dim, by) for dim in ("sku", "region")}
    return {
        "kpis": kpis,
        "revenue_trend": kpi.monthly_revenue(sales, by),
        "anomalies": an.ranked(found),
        **{f"performers_{dim}": performers.ranked_performers(df, by) for dim, df in ranking.items()},
        "performers_channel": performers.ranked_performers(
            performers.performers_latest_month(feeds["sales"], "channel", ("currency",)), ("currency",)),
        "risks": risks.risk_flags(inventory, ranking["sku"], ranking["region"], found, by=by),
    }


def _labels(feeds: Feeds, scope: ReportScope, where: ResolvedScope, margin_known: bool) -> DataFrame:
    """One row of names and flags that head the report."""
    if scope.span:
        period = range_label(F.lit(scope.span[0]), F.lit(scope.span[1]))
    elif where.anchor:
        period = month_label(F.lit(where.anchor))
    else:
        period = F.lit("No data yet")
    one = feeds["sales"].sparkSession.range(1)
    return one.select(
        period.alias("period_label"), F.lit("vs. prior period" if scope.span else "MoM").alias("comparison_label"),
        F.lit(where.anchor.strftime("%Y-%m") if where.anchor else None).cast("string").alias("anchor_month"),
        F.lit(where.currency).cast("string").alias("effective_currency"),
        F.lit(where.channel).cast("string").alias("effective_channel"),
        F.lit(where.several_currencies).alias("several_currencies"),
        F.lit(where.bounds is not None).alias("has_sales"),
        *[F.lit(feeds.get(n) is not None).alias(f"has_{n}") for n in ("orders", "returns", "inventory")],
        F.lit(None if margin_known else MARGIN_CAVEAT).cast("string").alias("margin_caveat"),
        F.lit(CHANNEL_CAVEAT.format(where.channel) if where.channel else None).cast("string").alias("return_rate_caveat"))


# ---- export and context payloads ------------------------------------------------------------------------------------

def _scope_values(report: Report) -> tuple[str, str, str | None, str | None, bool]:
    row = report["labels"].first()
    return (row["period_label"], row["comparison_label"], row["effective_currency"], row["effective_channel"],
            row["several_currencies"])


def _performer_texts(df: DataFrame, code: str, comparison: str) -> DataFrame:
    return df.select(
        F.col("rank").alias("row_no"), "dimension_value", format_currency(F.col("current"), F.lit(code)).alias("revenue"),
        F.concat(format_delta(F.col("delta_pct")), F.lit(f" {comparison}")).alias("trend"))


def _anomaly_texts(anomalies: DataFrame, k: int) -> DataFrame:
    return an.strongest(anomalies, k).select(
        F.col("rank").alias("row_no"), "metric_label", "dimension_value",
        F.concat_ws(" ", "period_label", "period").alias("period"), format_number(F.col("observed")).alias("observed"),
        format_number(F.col("baseline")).alias("baseline"),
        format_deviation(F.col("method"), F.col("deviation")).alias("deviation"), "method", "severity",
        format_method(F.col("method"), F.col("threshold")).alias("method_caption"))


def _kpi_texts(report: Report, code: str) -> DataFrame:
    return format_kpis(report["kpis"], F.lit(code)).select(
        F.col("kpi_ord").alias("row_no"), "label", F.col("current_text").alias("current"),
        F.col("mom_text").alias("mom"), F.col("qoq_text").alias("qoq"), F.col("yoy_text").alias("yoy"))


def _currency_note(report: Report, code: str) -> Column:
    """Names every currency found; one value per currency code is gathered."""
    names = report["judged_currencies"].agg(F.array_join(F.array_sort(F.collect_set("currency")), ", ")).scalar()
    return F.concat(F.lit(CURRENCY_NOTE[0]), names, F.lit(CURRENCY_NOTE[1]), F.lit(code), F.lit(CURRENCY_NOTE[2]))


def export_tables(report: Report, feeds: Feeds, actioned: list[str] = (), notes: list[str] = (),
                  summary: DataFrame | None = None, generated_at: dt.datetime | None = None) -> dict[str, DataFrame]:
    """The export as tables: header lines, summary texts, KPIs, recommendations, risks, anomalies, performers, datasets.

    ``summary`` is a one-row coerced executive summary; ``actioned`` lists the titles of finished recommendations.
    """
    period, comparison, currency, channel, several = _scope_values(report)
    code = currency or DEFAULT_CURRENCY
    spark = report["labels"].sparkSession
    stamp = F.lit(generated_at) if generated_at else F.current_timestamp()
    lines = [("Business Performance Report", F.lit("")), ("Reporting period", F.lit(period)),
             ("Generated", F.date_format(stamp, "MMM d, yyyy, h:mm a"))]
    if several:
        lines.append(("Currency scope", _currency_note(report, code)))
    if channel:
        lines.append(("Channel scope", F.lit(CHANNEL_NOTE.format(channel))))
    lines += [("Business context", F.lit(n)) for n in notes]
    headline = F.lit(NO_SUMMARY) if summary is None else F.coalesce(
        summary.limit(1).agg(F.first("headline")).scalar(), F.lit(NO_SUMMARY))
    lines.append(("Headline", headline))
    tables = {
        "summary": spark.range(1).select(F.inline(F.array(*[
            F.struct(F.lit(i).alias("row_no"), F.lit(name).alias("item"), text.alias("text"))
            for i, (name, text) in enumerate(lines)]))),
        "kpis": _kpi_texts(report, code),
        "risks": report["risks"],
        "anomalies": _anomaly_texts(report["anomalies"], EXPORT_ANOMALIES),
        "top_performers": _performer_texts(
            top_k(report["performers_sku"], 5, performers.best_order()), code, comparison),
        "bottom_performers": _performer_texts(
            top_k(report["performers_sku"], 5, performers.worst_order()), code, comparison),
    }
    if summary is not None:
        tables["sections"] = summary.select(F.posexplode("sections").alias("section_no", "section")).select(
            "section_no", "section.heading", F.posexplode("section.bullets").alias("bullet_no", "bullet"))
        done = F.col("title").isin(list(actioned)) if actioned else F.lit(False)
        tables["recommendations"] = summary.select(F.posexplode("recommendations").alias("row_no", "r")).select(
            "row_no", "r.*").withColumn("actioned", done)
    for name in DATASET_LABELS:
        if feeds.get(name) is not None:
            tables[f"dataset_{name}"] = feeds[name]
    return tables


def _gather(df: DataFrame, *columns: str) -> Column:
    """The few rows of an already cut table as one array, in row order."""
    rows = F.array_sort(F.collect_list(F.struct("row_no", *columns)))
    return df.agg(F.transform(rows, lambda r: F.struct(*[r[c].alias(c) for c in columns]))).scalar()


def report_context(report: Report, actioned: list[str] = (), notes: list[str] = ()) -> DataFrame:
    """One JSON document with everything a narrator may quote: KPIs, 8 anomalies, 5 best and worst SKUs, risks, notes."""
    period, comparison, currency, _, _ = _scope_values(report)
    code = currency or DEFAULT_CURRENCY
    sentences = an.strongest(report["anomalies"], CONTEXT_ANOMALIES).select(
        F.col("rank").alias("row_no"),
        F.concat(F.col("metric_label"), F.lit(" for "), F.col("dimension_value"), F.lit(" was "), F.col("direction"),
                 F.lit(" baseline "), F.col("period_label"), F.lit(" "), F.col("period"), F.lit(" (observed "),
                 format_number(F.col("observed")), F.lit(" vs. expected ~"), format_number(F.col("baseline")),
                 F.lit(", "), F.col("method"), F.lit(" method).")).alias("summary"))

    def sellers(order: list[Column]) -> Column:
        texts = _performer_texts(top_k(report["performers_sku"], 5, order), code, comparison)
        return _gather(texts.select("row_no", F.lit("SKU").alias("dimension"), F.col("dimension_value").alias("label"),
                                    "revenue", "trend"), "dimension", "label", "revenue", "trend")

    def words(items: list[str]) -> Column:
        return F.array(*[F.lit(i) for i in items]).cast("array<string>")

    document = F.struct(
        F.lit(period).alias("periodLabel"),
        _gather(_kpi_texts(report, code), "label", "current", "mom", "qoq", "yoy").alias("kpis"),
        _gather(sentences, "summary").alias("topAnomalies"),
        sellers(performers.best_order()).alias("topPerformers"),
        sellers(performers.worst_order()).alias("bottomPerformers"),
        _gather(report["risks"].withColumnRenamed("item", "row_no"), "type", "title", "detail").alias("risks"),
        words(list(actioned)[-CONTEXT_ACTIONS:]).alias("actionedRecommendations"),
        F.lit(currency).cast("string").alias("reportingCurrency"),
        words(list(notes)).alias("contextNotes"))
    return report["labels"].sparkSession.range(1).select(
        F.lit(period).alias("period_label"), F.to_json(document, {"ignoreNullFields": "false"}).alias("context"))
