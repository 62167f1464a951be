"""KPIs: revenue, units, order volume, return rate, margin, with period-over-period deltas.

Every feed is read once and folded to one row per (scope, period, SKU at most); anchors, quarters and deltas are then
worked out on that small table. A large cost table is joined after a fold per SKU, so a SKU that fills a third of the
feed still arrives at the join as one row per period.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import month_key, month_start, quarter_start, shift_month, shift_quarter
from ..sources.schema import ORD
from ..spark_tools import small_rows
from .scoping import ROWS, DateRange, by_columns, count_rows, previous_span

# The five KPIs with label, display format and whether more is better.
KPIS = (
    ("revenue", "Total revenue", "currency", True),
    ("units", "Units sold", "number", True),
    ("orders", "Order volume", "number", True),
    ("returnRate", "Return rate", "percent", False),
    ("avgMargin", "Avg. margin", "percent", True),
)
SMALL_COSTS = 100_000
MEASURES = ("revenue", "units", "cost", "costed_revenue", "n_sales", "n_orders", "returned_units")


def unit_cost_by_sku(inventory: DataFrame) -> DataFrame:
    """First unit cost in file order for every SKU."""
    return (
        inventory.filter(F.col("sku").isNotNull() & (F.col("sku") != ""))
        .groupBy("sku").agg(F.coalesce(F.min_by("unitCost", ORD), F.lit(0).cast("decimal(18,4)")).alias("unitCost"))
    )


class _Costs:
    """Unit costs with what is known about their size before the plan is made.

    Up to ``SMALL_COSTS`` SKUs they are broadcast and joined to the lines; beyond that the lines are folded per SKU first
    and meet the costs in a shuffle join.
    """

    def __init__(self, unit_cost: DataFrame | None):
        self.table, self.small, self.known = unit_cost, False, F.lit(False)
        if unit_cost is None:
            return
        rows = small_rows(unit_cost.select("sku", "unitCost"), SMALL_COSTS)
        if rows is None:
            self.known = F.lit(True)
        else:
            self.small, self.known = True, F.lit(rows.num_rows > 0)
            local = unit_cost.sparkSession.createDataFrame(rows, unit_cost.select("sku", "unitCost").schema)
            self.table = F.broadcast(local)


def _fold_sales(sales: DataFrame, costs: _Costs, keys: list[Column], names: list[str]) -> DataFrame:
    sums = [F.sum("revenue").alias("revenue"), F.sum("units").alias("units"), count_rows(sales).alias("n_sales")]
    if costs.table is None:
        return sales.groupBy(*keys).agg(*sums)
    # a product of two decimals would leave the fast 18 digits on every line; cost only ever feeds a ratio
    spent = F.sum(F.col("unitCost").cast("double") * F.col("units")).alias("cost")
    covered = F.sum(F.when(F.col("unitCost").isNotNull(), F.col("revenue"))).alias("costed_revenue")
    if costs.small:
        kept = ["sku", "revenue", "units", *([ROWS] if ROWS in sales.columns else [])]
        return sales.select(*keys, *kept).join(costs.table, "sku", "left").groupBy(*names).agg(
            *sums, spent, covered)
    return (
        sales.groupBy(*keys, "sku").agg(*sums).join(costs.table, "sku", "left").groupBy(*names)
        .agg(F.sum("revenue").alias("revenue"), F.sum("units").alias("units"), F.sum("n_sales").alias("n_sales"),
             spent, covered)
    )


def kpi_rollup(sales: DataFrame, orders: DataFrame | None, returns: DataFrame | None, costs: _Costs,
               period: Callable[[Column], Column], by: tuple[str, ...] = ()) -> DataFrame:
    """One row per scope and period with the sums every KPI is made of."""
    names = [*by, "period"]

    def keys(df: DataFrame, date_col: str) -> list[Column]:
        return [*by_columns(df, by), period(F.col(date_col)).alias("period")]

    parts = [_fold_sales(sales, costs, keys(sales, "date"), names)]
    if orders is not None:
        parts.append(orders.groupBy(*keys(orders, "orderDate")).agg(count_rows(orders).alias("n_orders")))
    if returns is not None:
        parts.append(returns.groupBy(*keys(returns, "returnDate")).agg(F.sum("units").alias("returned_units")))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    present = set(merged.columns)
    return merged.groupBy(*names).agg(
        *[(F.coalesce(F.sum(m), F.lit(0)) if m in present else F.lit(0)).alias(m) for m in MEASURES])


def _snapshot(m: Callable[[str], Column], has_cost: Column, has_returns: bool) -> dict[str, Column]:
    revenue, units, cost = m("revenue").cast("double"), m("units").cast("double"), m("cost").cast("double")
    none = F.lit(None).cast("double")
    margin = (m("revenue") - m("cost")).cast("double") / revenue
    return {
        "revenue": revenue,
        "units": units,
        "orders": m("n_orders").cast("double"),
        "returnRate": F.when(units > 0, m("returned_units").cast("double") / units) if has_returns else none,
        "avgMargin": F.when(has_cost & (revenue > 0), margin),
    }


def delta_pct(current: Column, previous: Column, has_previous: Column) -> Column:
    return F.when(has_previous & (previous != 0), (current - previous) / previous)


def _long_rows(df: DataFrame, by: tuple[str, ...], extra: list[str], rows: list[dict[str, Column]]) -> DataFrame:
    structs = [
        F.struct(F.lit(i).alias("kpi_ord"), F.lit(k).alias("kpi"), F.lit(label).alias("label"),
                 F.lit(fmt).alias("format"), F.lit(better).alias("higher_is_better"),
                 *[c.alias(n) for n, c in row.items()])
        for i, ((k, label, fmt, better), row) in enumerate(zip(KPIS, rows))
    ]
    return df.select(*by, *extra, F.inline(F.array(*structs)))


def kpi_snapshot(sales: DataFrame, orders: DataFrame | None, returns: DataFrame | None, unit_cost: DataFrame | None,
                 by: tuple[str, ...] = ()) -> DataFrame:
    """Totals over everything given: one row per scope, plus the revenue share whose SKU has a known cost."""
    costs = _Costs(unit_cost)
    rolled = kpi_rollup(sales, orders, returns, costs, lambda d: F.lit("all"), by)
    snap = _snapshot(F.col, F.col("has_cost"), returns is not None)
    share = F.when(F.col("revenue") > 0, F.col("costed_revenue").cast("double") / F.col("revenue").cast("double"))
    return rolled.withColumn("has_cost", costs.known).select(
        *by, *[c.alias(k) for k, c in snap.items()], share.alias("costedRevenueShare"))


def _first_needed_day(sales: DataFrame, by: tuple[str, ...]) -> dt.date | None:
    last = sales.groupBy(*by_columns(sales, by)).agg(F.max("date").alias("last")).agg(F.min("last")).first()[0]
    return dt.date(last.year - 1, last.month, 1) if last else None


def kpi_trend(sales: DataFrame, orders: DataFrame | None, returns: DataFrame | None, unit_cost: DataFrame | None,
              by: tuple[str, ...] = ()) -> DataFrame:
    """Latest month of each scope with month, quarter and year deltas: five rows per scope.

    The earliest of the scopes' latest months is looked up first, from the date and scope columns alone; the feeds are then
    read from twelve months before it, which covers the quarter before as well.
    """
    costs = _Costs(unit_cost)
    since = _first_needed_day(sales, by)
    if since is not None:
        sales = sales.filter(F.col("date") >= F.lit(since))
        orders = orders.filter(F.col("orderDate") >= F.lit(since)) if orders is not None else None
        returns = returns.filter(F.col("returnDate") >= F.lit(since)) if returns is not None else None
    rolled = kpi_rollup(sales, orders, returns, costs, month_start, by).filter(F.col("period").isNotNull())
    # one row per month is left, so a window over a whole scope is bounded by the calendar
    latest = F.max(F.when(F.col("n_sales") > 0, F.col("period"))).over(W.partitionBy(*by))
    rolled = rolled.withColumn("anchor", latest).filter(F.col("anchor").isNotNull())

    month, anchor = F.col("period"), F.col("anchor")
    quarter, anchor_quarter = quarter_start(month), quarter_start(anchor)
    slices = {
        "cur": month == anchor,
        "mom": month == shift_month(anchor, -1),
        "yoy": month == shift_month(anchor, -12),
        "quarter": quarter == anchor_quarter,
        "qoq": quarter == shift_quarter(anchor_quarter, -1),
    }
    sums = [
        F.coalesce(F.sum(F.when(cond, F.col(m))), F.lit(0)).alias(f"{s}_{m}")
        for s, cond in slices.items() for m in MEASURES if m != "costed_revenue"
    ]
    wide = rolled.groupBy(*by, "anchor").agg(*sums).withColumn("has_cost", costs.known)
    wide = wide.withColumn("anchor_month", month_key(F.col("anchor")))

    snaps = {s: _snapshot(lambda m, s=s: F.col(f"{s}_{m}"), F.col("has_cost"), returns is not None) for s in slices}
    seen = {s: F.col(f"{s}_n_sales") > 0 for s in slices}
    rows = [
        {"current": snaps["cur"][k],
         "mom": delta_pct(snaps["cur"][k], snaps["mom"][k], seen["mom"]),
         "qoq": delta_pct(snaps["quarter"][k], snaps["qoq"][k], seen["qoq"]),
         "yoy": delta_pct(snaps["cur"][k], snaps["yoy"][k], seen["yoy"])}
        for k, *_ in KPIS
    ]
    return _long_rows(wide, by, ["anchor_month"], rows)


def kpi_range_trend(sales: DataFrame, orders: DataFrame | None, returns: DataFrame | None, unit_cost: DataFrame | None,
                    span: DateRange, by: tuple[str, ...] = ()) -> DataFrame:
    """A custom range against the equally long range before it. Feed full history; only the two ranges are scanned."""
    before = previous_span(span)

    def clip(df: DataFrame | None, column: str) -> DataFrame | None:
        return None if df is None else df.filter(F.col(column).between(F.lit(before[0]), F.lit(span[1])))

    costs = _Costs(unit_cost)
    rolled = kpi_rollup(clip(sales, "date"), clip(orders, "orderDate"), clip(returns, "returnDate"), costs,
                        lambda d: F.when(d >= F.lit(span[0]), "cur").otherwise("prev"), by)
    sums = [
        F.coalesce(F.sum(F.when(F.col("period") == s, F.col(m))), F.lit(0)).alias(f"{s}_{m}")
        for s in ("cur", "prev") for m in MEASURES if m != "costed_revenue"
    ]
    wide = rolled.groupBy(*by).agg(*sums).withColumn("has_cost", costs.known)
    cur, prev = (
        _snapshot(lambda m, s=s: F.col(f"{s}_{m}"), F.col("has_cost"), returns is not None) for s in ("cur", "prev")
    )
    none = F.lit(None).cast("double")
    rows = [
        {"current": cur[k], "mom": delta_pct(cur[k], prev[k], F.col("prev_n_sales") > 0), "qoq": none, "yoy": none}
        for k, *_ in KPIS
    ]
    return _long_rows(wide.withColumn("anchor_month", F.lit(None).cast("string")), by, ["anchor_month"], rows)


def monthly_revenue(sales: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Revenue per month in calendar order; months without sales are absent."""
    return (
        sales.filter(F.col("date").isNotNull())
        .groupBy(*by_columns(sales, by), month_start(F.col("date")).alias("start"))
        .agg(F.sum("revenue").cast("double").alias("revenue"))
        .orderBy(*by, "start")
        .select(*by, month_key(F.col("start")).alias("month"), "revenue")
    )
