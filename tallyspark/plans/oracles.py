"""DuckDB statements that state, independently of Spark, what each registered query returns."""

from __future__ import annotations

from ..sources.schema import FIELDS
from ..sources.synthetic import GROWTH, SEASON, WEEKEND
from .rawfeeds import header_catalogue_sql, raw_feed_sql

_CURRENCY = "case c_nationkey % 3 when 0 then 'USD' when 1 then 'EUR' else 'INR' end"

VIEWS = {
    "v_sales": f"""select cast(l_shipdate as date) as date, cast(l_partkey as varchar) as sku, p_name as product,
 r_name as region, o_orderpriority as channel, l_quantity as units,
 cast(l_extendedprice as decimal(18,2)) as unitPrice,
 cast(cast(l_extendedprice as decimal(18,2)) * (1 - cast(l_discount as decimal(4,2))) as decimal(18,4)) as revenue,
 {_CURRENCY} as currency, l_orderkey as src_order, l_linenumber as src_line, l_returnflag as src_flag,
 l_orderkey * 8 + l_linenumber as _ord
 from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey
 join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey join part on l_partkey = p_partkey""",
    "v_orders": f"""select cast(o_orderkey as varchar) as orderId, cast(o_orderdate as date) as orderDate,
 cast(o_custkey as varchar) as customerId, o_orderpriority as channel, r_name as region, o_orderstatus as status,
 cast(o_totalprice as decimal(18,2)) as total, {_CURRENCY} as currency, o_orderkey as _ord
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
 join region on n_regionkey = r_regionkey""",
    "v_returns": """select concat(cast(src_order as varchar), '-', cast(src_line as varchar)) as returnId,
 cast(src_order as varchar) as orderId, sku, date as returnDate, src_flag as reason, units, revenue as refund, currency,
 _ord from v_sales where src_flag = 'R'""",
    "v_inventory": """select cast(l_partkey as varchar) as sku, p_name as productName,
 concat('DC-', cast(l_suppkey as varchar)) as warehouse, cast((l_partkey * 7 + l_suppkey * 13) % 200 as double) as onHand,
 cast(p_size as double) as reorderPoint,
 cast(cast(p_retailprice as decimal(18,2)) * cast(0.6 as decimal(2,1)) as decimal(18,3)) as unitCost,
 l_partkey * 1000000 + l_suppkey as _ord
 from (select distinct l_partkey, l_suppkey from lineitem) as x join part on l_partkey = p_partkey""",
}
_NEEDS = {"v_returns": ("v_sales",)}


def with_views(body: str, *names: str) -> str:
    """``body`` behind the canonical views it names; ``body`` may open with further ``name as (...)`` definitions."""
    wanted: list[str] = []
    for name in names:
        for v in (*_NEEDS.get(name, ()), name):
            if v not in wanted:
                wanted.append(v)
    ctes = ",\n".join(f"{v} as ({VIEWS[v]})" for v in wanted)
    return f"with {ctes}{', ' if not body.lstrip().lower().startswith('select') else ' '}{body}"


ORACLES: dict[str, str] = {}

# ---- KPIs -----------------------------------------------------------------------------------------------------------

_COST = "costs as (select sku, min(unitCost) as unitCost from v_inventory group by sku)"


def _kpi_sums(where_sales: str, where_orders: str, where_returns: str, tag: str) -> str:
    """One-row-per-currency sums of a slice given by three predicates, named after ``tag``."""
    return f"""{tag}_s as (select currency, sum(revenue) as revenue, sum(units) as units, count(*) as n,
 sum(cast(units as decimal(18,4)) * unitCost) as cost,
 sum(case when unitCost is not null then revenue end) as costed
 from v_sales left join costs using (sku) {where_sales} group by currency),
{tag}_o as (select v_orders.currency, count(*) as n from v_orders {where_orders} group by v_orders.currency),
{tag}_r as (select v_returns.currency, sum(units) as units from v_returns {where_returns} group by v_returns.currency),
{tag} as (select c.currency, coalesce(s.n, 0) as n, cast(coalesce(s.revenue, 0) as double) as revenue,
 cast(coalesce(s.units, 0) as double) as units, cast(coalesce(o.n, 0) as double) as orders,
 case when s.units > 0 then coalesce(r.units, 0) / s.units end as returnRate,
 case when s.revenue > 0 then cast(s.revenue - coalesce(s.cost, 0) as double) / cast(s.revenue as double) end as avgMargin,
 case when s.revenue > 0 then cast(s.costed as double) / cast(s.revenue as double) end as share
 from (select distinct currency from v_sales) c left join {tag}_s s using (currency)
 left join {tag}_o o using (currency) left join {tag}_r r using (currency))"""


_KPI_NAMES = {"revenue": ("Total revenue", "currency"), "units": ("Units sold", "number"),
              "orders": ("Order volume", "number"), "returnRate": ("Return rate", "percent"),
              "avgMargin": ("Avg. margin", "percent")}

ORACLES["kpi_snapshot"] = with_views(
    _COST + ", " + _kpi_sums("", "", "", "a") + """
select currency, revenue, units, orders, round(returnRate, 6) as "returnRate", round(avgMargin, 6) as "avgMargin",
 round(share, 6) as "costedRevenueShare" from a""", "v_sales", "v_orders", "v_returns", "v_inventory")


def _delta(cur: str, prev: str, k: str) -> str:
    return (f"round(case when {prev}.n > 0 and {prev}.{k} <> 0 then ({cur}.{k} - {prev}.{k}) / {prev}.{k} end, 6)")


def _month_slice(tag: str, test: str) -> str:
    def where(view: str, col: str) -> str:
        return f"join anchors a on a.currency = {view}.currency where {test.format(d=f'{view}.{col}')}"
    return _kpi_sums(where("v_sales", "date"), where("v_orders", "orderDate"), where("v_returns", "returnDate"), tag) \
        .replace("select currency, sum(revenue)", "select v_sales.currency, sum(revenue)") \
        .replace("group by currency),", "group by v_sales.currency),", 1)


def kpi_trend_ctes() -> str:
    month, quarter = "date_trunc('month', {d})", "date_trunc('quarter', {d})"
    return ", ".join([
        _COST, "anchors as (select currency, date_trunc('month', max(date)) as m from v_sales group by currency)",
        _month_slice("cur", f"{month} = a.m"),
        _month_slice("pm", f"{month} = a.m - interval 1 month"),
        _month_slice("py", f"{month} = a.m - interval 12 month"),
        _month_slice("cq", f"{quarter} = date_trunc('quarter', a.m)"),
        _month_slice("pq", f"{quarter} = date_trunc('quarter', a.m) - interval 3 month"),
        "kpis as (" + " union all ".join(
            f"""select cur.currency, strftime(a.m, '%Y-%m') as anchor_month, '{k}' as kpi, '{label}' as label,
 '{fmt}' as format, round(cur.{k}, 6) as current, {_delta('cur', 'pm', k)} as mom, {_delta('cq', 'pq', k)} as qoq,
 {_delta('cur', 'py', k)} as yoy
 from cur join pm using (currency) join py using (currency) join cq using (currency) join pq using (currency)
 join anchors a using (currency)""" for k, (label, fmt) in _KPI_NAMES.items()) + ")",
    ])


ORACLES["kpi_trend"] = with_views(kpi_trend_ctes() + " select * from kpis",
                                  "v_sales", "v_orders", "v_returns", "v_inventory")


def _between(d: str, a: str, b: str) -> str:
    return f"where {d} between date '{a}' and date '{b}'"


_R = ("2001-02-10", "2001-05-20")
_P = ("2000-11-02", "2001-02-09")  # the 100 days before

ORACLES["kpi_range_trend"] = with_views(", ".join([
    _COST,
    _kpi_sums(_between("date", *_R), _between("orderDate", *_R), _between("returnDate", *_R), "cur"),
    _kpi_sums(_between("date", *_P), _between("orderDate", *_P), _between("returnDate", *_P), "prev"),
]) + " ".join(["", " union all ".join(
    f"""select cur.currency, cast(null as varchar) as anchor_month, '{k}' as kpi, '{label}' as label, '{fmt}' as format,
 round(cur.{k}, 6) as current, {_delta('cur', 'prev', k)} as mom, cast(null as double) as qoq, cast(null as double) as yoy
 from cur join prev using (currency)""" for k, (label, fmt) in _KPI_NAMES.items())]),
    "v_sales", "v_orders", "v_returns", "v_inventory")

ORACLES["monthly_revenue"] = with_views(
    """select currency, strftime(date, '%Y-%m') as month, cast(sum(revenue) as double) as revenue
 from v_sales group by 1, 2""", "v_sales")

# ---- performers -----------------------------------------------------------------------------------------------------


def _performer_cols(cur: str, prev: str) -> str:
    return f"""cast(sum(case when {cur} then revenue else 0 end) as double) as current,
 case when sum(case when {prev} then revenue else 0 end) > 0
  then cast(sum(case when {prev} then revenue else 0 end) as double) end as previous"""


_DELTA = "round((current - previous) / previous, 6) as delta_pct"


def _performers_month(dim: str) -> str:
    month = "date_trunc('month', date)"
    return with_views(f"""anchors as (select currency, date_trunc('month', max(date)) as m from v_sales group by currency),
 t as (select currency, {dim} as dimension_value, {_performer_cols(f'{month} = m', f'{month} = m - interval 1 month')}
 from v_sales join anchors using (currency) where {month} in (m, m - interval 1 month) group by 1, 2)
 select currency, dimension_value, current, previous, {_DELTA} from t""", "v_sales")


for _d in ("sku", "region", "channel"):
    ORACLES[f"performers_{_d}_month"] = _performers_month(_d)

_CUR, _PREV = (f"date between date '{a}' and date '{b}'" for a, b in (_R, _P))
_RANGE_SKU = f"""t as (select currency, sku as dimension_value, {_performer_cols(_CUR, _PREV)} from v_sales
 where {_CUR} or {_PREV} group by 1, 2), p as (select currency, dimension_value, current, previous, {_DELTA} from t)"""

ORACLES["performers_sku_range"] = with_views(_RANGE_SKU + " select * from p", "v_sales")


def _top_bottom(partition: str, where: str, columns: str) -> str:
    numbered = f"""n as (select *, row_number() over ({partition} order by current desc, dimension_value) as up,
 row_number() over ({partition} order by current, dimension_value desc) as down from p {where})"""
    return with_views(f"""{_RANGE_SKU}, {numbered}
 select {columns}, cast(up as integer) as rank, 'top' as side from n where up <= 5
 union all select {columns}, cast(down as integer) as rank, 'bottom' as side from n where down <= 5""", "v_sales")


_PCOLS = "dimension_value, current, previous, delta_pct"
ORACLES["top_bottom_sku"] = _top_bottom("partition by currency", "", f"currency, {_PCOLS}").replace("<= 5", "<= 10")
ORACLES["top_bottom_by_currency"] = _top_bottom("partition by currency", "", f"currency, {_PCOLS}")

# ---- currencies and channels ----------------------------------------------------------------------------------------

ORACLES["currency_breakdown"] = with_views(
    """s as (select currency, cast(sum(revenue) as double) as revenue, sum(units) as units from v_sales group by 1),
 o as (select currency, count(*) as orders from v_orders group by 1),
 r as (select currency, count(*) as returns, cast(sum(refund) as double) as refund from v_returns group by 1)
 select currency, coalesce(revenue, 0) as revenue, coalesce(units, 0) as units, coalesce(orders, 0) as orders,
 coalesce(returns, 0) as returns, coalesce(refund, 0) as refund
 from s full join o using (currency) full join r using (currency)""", "v_sales", "v_orders", "v_returns")

for _d in ("region", "channel", "sku"):
    ORACLES[f"revenue_by_{_d}_currency"] = with_views(
        f"""c as (select currency, {_d} as dimension_value, sum(revenue) as current from v_sales group by 1, 2)
 select currency, dimension_value, cast(current as double) as current,
 cast(sum(current) over (partition by currency) as double) as group_total from c""", "v_sales")

ORACLES["category_cut"] = with_views(
    f"""{_RANGE_SKU}, n as (select *, row_number() over (partition by currency order by current desc, dimension_value) as rank
 from p) select currency, rank, dimension_value, current from n where rank <= 6""", "v_sales")
ORACLES["category_cut_by_currency"] = with_views(
    """c as (select currency, sku as dimension_value, sum(revenue) as s from v_sales group by 1, 2),
 n as (select *, row_number() over (partition by currency order by s desc, dimension_value) as rank from c)
 select currency, rank, dimension_value, cast(s as double) as current from n where rank <= 5""", "v_sales")
ORACLES["available_currencies"] = with_views(
    "select currency from v_sales union select currency from v_orders union select currency from v_returns",
    "v_sales", "v_orders", "v_returns")
ORACLES["default_currency"] = with_views(
    "select currency, count(*) as n_rows from v_sales group by 1 order by 2 desc, min(_ord), 1 limit 1", "v_sales")
ORACLES["available_channels"] = with_views(
    "select channel from v_sales union select channel from v_orders", "v_sales", "v_orders")

# ---- series and anomalies -------------------------------------------------------------------------------------------

_WEEKS = """wk as (select sku as dimension_value, cast(date - cast(dayofweek(date) as integer) as date) as start,
 sum(units) as value, count(*) as n_rows from v_sales group by 1, 2)"""
_RETURN_MONTHS = """rm as (select sku as dimension_value, cast(date_trunc('month', returnDate) as date) as start,
 sum(units) as value, count(*) as n_rows from v_returns group by 1, 2)"""
_REGION_MONTHS = """gm as (select currency, region as dimension_value, cast(date_trunc('month', date) as date) as start,
 cast(sum(revenue) as double) as value, count(*) as n_rows from v_sales group by 1, 2, 3)"""

ORACLES["sku_week_buckets"] = with_views(
    _WEEKS + " select dimension_value, strftime(start, '%Y-%m-%d') as period, value, n_rows from wk", "v_sales")


def _span(grain: str) -> str:
    if grain == "week":
        return "strftime(start, '%Y-%m-%d') as period, start as span_start, cast(start + 6 as date) as span_end"
    return "strftime(start, '%Y-%m') as period, start as span_start, last_day(start) as span_end"


def zscore_sql(source: str, grain: str, metric: str, label: str, t: str = "2.5", by: str = "", extra: str = "",
               dim: str = "sku") -> str:
    """Select over bucket CTE ``source``; ``t`` may be a column of ``extra`` (a join clause)."""
    part = f"partition by {by}dimension_value"
    return f"""select {by}concat('{dim}:', dimension_value, ':', period, ':zscore') as id, 'zscore' as method,
 cast({t} as double) as threshold, '{dim}' as dimension_type, dimension_value, '{metric}' as metric_label,
 '{label}' as period_label, period, span_start, span_end, round(value, 6) as observed, round(m, 6) as baseline,
 round(z, 6) as deviation, case when abs(z) >= {t} + 1.5 then 'high' else 'medium' end as severity,
 case when z >= 0 then 'above' else 'below' end as direction, n_rows
 from (select *, (value - m) / sd as z from (select *, {_span(grain)}, avg(value) over ({part}) as m,
  stddev_pop(value) over ({part}) as sd, count(*) over ({part}) as n from {source}) x where n >= 6 and sd > 0) y {extra}
 where abs(z) >= {t}"""


def iqr_sql(source: str, grain: str, metric: str, label: str, t: str = "1.5", by: str = "", extra: str = "",
            dim: str = "sku") -> str:
    part = f"partition by {by}dimension_value"
    return f"""select {by}concat('{dim}:', dimension_value, ':', period, ':iqr') as id, 'iqr' as method,
 cast({t} as double) as threshold, '{dim}' as dimension_type, dimension_value, '{metric}' as metric_label,
 '{label}' as period_label, period, span_start, span_end, round(value, 6) as observed,
 round((q1 + q3) / 2, 6) as baseline, round((value - (q1 + q3) / 2) / (q3 - q1), 6) as deviation,
 case when value > q3 + ({t} + 1) * (q3 - q1) or value < q1 - ({t} + 1) * (q3 - q1) then 'high' else 'medium' end as severity,
 case when value >= q3 + {t} * (q3 - q1) then 'above' else 'below' end as direction, n_rows
 from (select *, {_span(grain)}, quantile_cont(value, 0.25) over ({part}) as q1,
  quantile_cont(value, 0.75) over ({part}) as q3, count(*) over ({part}) as n from {source}) x {extra}
 where n >= 6 and q3 > q1 and (value < q1 - {t} * (q3 - q1) or value > q3 + {t} * (q3 - q1))"""


def rolling_sql(source: str, t: str = "0.25", by: str = "currency, ", extra: str = "") -> str:
    frame = f"partition by {by}dimension_value order by start rows between 3 preceding and 1 preceding"
    return f"""select {by}concat('region:', dimension_value, ':', period, ':rolling') as id,
 'rolling-baseline' as method, cast({t} as double) as threshold, 'region' as dimension_type, dimension_value,
 'Monthly revenue' as metric_label, 'in' as period_label, period, span_start, span_end, round(value, 6) as observed,
 round(base, 6) as baseline, round(dev, 6) as deviation,
 case when abs(dev) >= {t} * 1.6 then 'high' else 'medium' end as severity,
 case when dev >= 0 then 'above' else 'below' end as direction, n_rows
 from (select *, (value - base) / base as dev from (select *, {_span('month')}, avg(value) over w as base,
  count(*) over w as n from {source} window w as ({frame})) x where n = 3 and base <> 0) y {extra}
 where abs(dev) >= {t}"""


_W, _M = ("Weekly units sold", "week of"), ("Monthly returned units", "in")
ORACLES["sku_units_zscore"] = with_views(_WEEKS + " " + zscore_sql("wk", "week", *_W), "v_sales")
ORACLES["sku_units_iqr"] = with_views(_WEEKS + " " + iqr_sql("wk", "week", *_W), "v_sales")
ORACLES["sku_returns_zscore"] = with_views(_RETURN_MONTHS + " " + zscore_sql("rm", "month", *_M), "v_returns")
ORACLES["sku_returns_iqr"] = with_views(_RETURN_MONTHS + " " + iqr_sql("rm", "month", *_M), "v_returns")
ORACLES["region_rolling_baseline"] = with_views(_REGION_MONTHS + " " + rolling_sql("gm"), "v_sales")

# ---- key reconciliation ---------------------------------------------------------------------------------------------

def _clean_keys(*datasets: str) -> str:
    """Cleaned feeds as ``k_<dataset>``, without dropped rows; the placeholder is no key."""
    return ", ".join(_coerced(d) for d in datasets) + "".join(
        f", k_{d} as (select * from c_{d} where not dropped)" for d in datasets)


def _cross_reference() -> None:
    ORACLES["xref_sales_inventory"] = with_views(
        _clean_keys("sales", "inventory") + """ select distinct sku as key from k_sales
 where sku <> 'Unknown' and sku not in (select sku from k_inventory)""", "v_sales", "v_inventory")
    ORACLES["xref_returns_orders"] = with_views(
        _clean_keys("returns", "orders") + """ select distinct orderId as key from k_returns
 where orderId <> 'Unknown' and orderId not in (select orderId from k_orders)""", "v_orders", "v_returns")
    ORACLES["xref_returns_sales"] = with_views(
        _clean_keys("returns", "sales") + """, k as (select distinct sku from k_returns where sku <> 'Unknown')
 select count(*) as keys, count(*) filter (where sku not in (select sku from k_sales)) as unmatched from k""",
        "v_sales", "v_returns")
    ORACLES["xref_report"] = with_views(
        """i as (select case when sku like '%0' then 'X' || sku else sku end as sku from v_inventory),
 r as (select case when orderId like '%7' then 'X' || orderId else orderId end as orderId,
  case when sku like '%99' then 'X' || sku else sku end as sku from v_returns),
 a as (select count(distinct sku) as n, count(distinct sku) filter
  (where sku not in (select sku from i)) as u from v_sales),
 b as (select count(distinct orderId) as n, count(distinct orderId) filter
  (where orderId not in (select orderId from v_orders)) as u from r),
 c as (select count(distinct sku) as n, count(distinct sku) filter
  (where sku not in (select sku from v_sales)) as u from r)
 select 0 as check_ord, 'Sales SKUs vs. inventory' as label, case when u = 0 then concat('All ', n,
  ' SKUs sold have a matching inventory record.') else concat(u, ' of ', n,
  ' SKUs sold have no matching inventory record.') end as detail, u = 0 as clean from a
 union all select 1, 'Return order IDs vs. orders', case when u = 0 then concat('All ', n,
  ' returns matched a known order.') else concat(u, ' of ', n,
  ' returns reference an order ID not found in Orders.') end, u = 0 from b
 union all select 2, 'Return SKUs vs. sales', case when u = 0 then concat('All ', n,
  ' returned SKUs matched a sales record.') else concat(u, ' of ', n,
  ' returned SKUs have no matching sales record.') end, u = 0 from c""",
        "v_sales", "v_orders", "v_returns", "v_inventory")


# ---- ranking, scoping and drill-down of anomalies -------------------------------------------------------------------

_BY_CURRENCY = "currency, "
_CWEEKS = _WEEKS.replace("wk as (select sku", "cw as (select currency, sku").replace("group by 1, 2)", "group by 1, 2, 3)")
_CRETURNS = _RETURN_MONTHS.replace("rm as (select sku", "cr as (select currency, sku").replace(
    "group by 1, 2)", "group by 1, 2, 3)")
_ALL = f"""{_CWEEKS}, {_CRETURNS}, {_REGION_MONTHS}, found as (
 select *, 0 as det from ({zscore_sql('cw', 'week', *_W, by=_BY_CURRENCY)}) a
 union all select *, 1 as det from ({zscore_sql('cr', 'month', *_M, by=_BY_CURRENCY)}) b
 union all select *, 2 as det from ({rolling_sql('gm')}) c)"""
ORACLES["anomalies_ranked"] = with_views(_ALL + " select * exclude (det) from found", "v_sales", "v_returns")
ORACLES["anomalies_in_range"] = with_views(
    _ALL + f" select * exclude (det) from found where span_start <= date '{_R[1]}' and span_end >= date '{_R[0]}'",
    "v_sales", "v_returns")


def _levels(strict: float, standard: float, lenient: float) -> str:
    return (f"cross join (values ('strict', cast({strict} as double)), ('standard', {standard}), "
            f"('lenient', {lenient})) as p(sensitivity, t)")


def _preset(sql: str) -> str:
    return sql.replace("select ", "select sensitivity, ", 1)


ORACLES["anomalies_all_presets"] = with_views(
    f"""{_WEEKS}, {_REGION_MONTHS}, {_RETURN_MONTHS}
 select * from ({_preset(rolling_sql('gm', 't', extra=_levels(0.4, 0.25, 0.15)))}) a
 union all by name select * from ({_preset(zscore_sql('wk', 'week', *_W, t='t', extra=_levels(3.5, 2.5, 1.75)))}) b
 union all by name select * from ({_preset(iqr_sql('wk', 'week', *_W, t='t', extra=_levels(3, 1.5, 0.75)))}) c
 union all by name select * from ({_preset(zscore_sql('rm', 'month', *_M, t='t', extra=_levels(3.5, 2.5, 1.75)))}) d
 union all by name select * from ({_preset(iqr_sql('rm', 'month', *_M, t='t', extra=_levels(3, 1.5, 0.75)))}) e""",
    "v_sales", "v_returns")

_TOP_WEEKS = f"""{_WEEKS}, z as ({zscore_sql('wk', 'week', *_W)}),
 top as (select *, row_number() over (order by abs(deviation) desc, dimension_value, period) as rank from z)"""
ORACLES["anomalies_strongest"] = with_views(
    _TOP_WEEKS + " select rank, id, deviation, severity from top where rank <= 12", "v_sales")
ORACLES["anomaly_drilldown"] = with_views(
    _TOP_WEEKS + """, hit as (select t.id, t.n_rows, s.*, row_number() over (partition by t.id
  order by s._ord, s.date, s.sku, s.channel, s.units, s.revenue) as row_no
  from top t join v_sales s on s.sku = t.dimension_value and s.date between t.span_start and t.span_end where rank <= 12)
 select id, n_rows, row_no, date, sku, channel, units, revenue from hit where row_no <= 20""", "v_sales")

ORACLES["trend_with_markers"] = with_views(
    f"""{_REGION_MONTHS}, tr as (select currency, strftime(date, '%Y-%m') as month,
  cast(sum(revenue) as double) as revenue from v_sales group by 1, 2),
 ro as (select *, row_number() over (partition by currency, period order by abs(deviation) desc, dimension_value) as rn
  from ({rolling_sql('gm')}) x),
 ends as (select currency, count(*) filter (where month = '2001-02') > 0 and count(*) filter (where month = '2001-05') > 0
  as shown from tr group by 1)
 select tr.currency, tr.month, tr.revenue, id as anomaly_id, dimension_value as anomaly_region,
  deviation as anomaly_deviation, shown and tr.month between '2001-02' and '2001-05' as highlighted
 from tr join ends using (currency) left join ro on ro.currency = tr.currency and ro.period = tr.month and rn = 1""",
    "v_sales")

ORACLES["anomaly_pick_by_metric"] = with_views(
    _ALL + """, r as (select *, row_number() over (partition by currency, metric_label
  order by abs(deviation) desc, dimension_value, period) as rn,
  case metric_label when 'Monthly revenue' then 0 when 'Weekly units sold' then 1 else 2 end as mo from found),
 k as (select *, row_number() over (partition by currency order by mo, rn) as pick from r
  where rn <= case mo when 2 then 1 else 2 end)
 select currency, pick, metric_label, id, deviation from k where pick <= 5""", "v_sales", "v_returns")

# ---- ranges and scope filters ---------------------------------------------------------------------------------------

_BOUNDS = 'b as (select min(date) as lo, max(date) as hi from v_sales)'
ORACLES["date_bounds"] = with_views(_BOUNDS + ' select lo as "start", hi as "end" from b', "v_sales")
ORACLES["range_presets"] = with_views(
    _BOUNDS + """, m as (select lo, hi, cast(date_trunc('month', hi) as date) as m0 from b)
 select 0 as preset_ord, 'currentMonth' as key, 'Current month' as label, cast(null as date) as range_start,
  cast(null as date) as range_end from m
 union all select 1, 'allTime', 'All time', lo, hi from m
 union all select 2, 'last30', 'Last 30 days', cast(hi - 29 as date), hi from m
 union all select 3, 'last90', 'Last 90 days', cast(hi - 89 as date), hi from m
 union all select 4, 'lastMonth', 'Last month', cast(m0 - interval 1 month as date), cast(m0 - interval 1 day as date) from m
 union all select 5, 'thisQuarter', 'This quarter', cast(date_trunc('quarter', hi) as date), hi from m
 union all select 6, 'thisYear', 'This year', cast(date_trunc('year', hi) as date), hi from m
 union all select 7, 'custom', 'Custom range', null, null from m""", "v_sales")
ORACLES["scoped_sales"] = with_views(
    f"""select date, sku, product, region, channel, units, unitPrice, revenue, currency from v_sales
 where {_CUR} and channel = '1-URGENT' and currency = 'INR'""", "v_sales")
ORACLES["sales_in_quarter"] = with_views(
    """select date, sku, region, units, currency from v_sales
 where year(date) = 2000 and quarter(date) = 3""", "v_sales")
ORACLES["period_keys"] = with_views(
    """d as (select date, count(*) as n_rows, cast(date_trunc('month', date) as date) as m from v_sales group by date)
 select date, n_rows, strftime(date, '%Y-%m') as month, concat(year(date), '-Q', quarter(date)) as quarter,
 strftime(date - cast(dayofweek(date) as integer), '%Y-%m-%d') as week, last_day(date) as month_end,
 strftime(m - interval 1 month, '%Y-%m') as month_before,
 concat(year(date - interval 3 month), '-Q', quarter(m - interval 3 month)) as quarter_before,
 cast(m - cast(date - m as integer) - 1 as date) as previous_start, cast(m - 1 as date) as previous_end,
 strftime(date, '%b %Y') as month_label,
 case when date = m then strftime(m, '%b %-d, %Y') else
  concat(strftime(m, '%b %-d, %Y'), ' – ', strftime(date, '%b %-d, %Y')) end as range_label from d""", "v_sales")

# ---- inventory and risks --------------------------------------------------------------------------------------------

_AT_RISK = """risky as (select *, onHand - reorderPoint as gap,
 row_number() over (order by onHand - reorderPoint, _ord) as worst, row_number() over (order by _ord) as n
 from v_inventory where reorderPoint > 0 and onHand <= reorderPoint)"""
_RISK_COLS = 'productName as label, onHand as "onHand", reorderPoint as "reorderPoint", warehouse, gap'
ORACLES["inventory_risk"] = with_views(f"{_AT_RISK} select {_RISK_COLS} from risky", "v_inventory")
ORACLES["inventory_worst_gaps"] = with_views(
    f"{_AT_RISK} select {_RISK_COLS}, worst as rank from risky where worst <= 8", "v_inventory")
_STOCKOUTS = """so as (select 'risk' as type, concat('Stockout risk: ', productName) as title,
 concat(cast(onHand as bigint), ' units on hand at ', warehouse, ' vs. a reorder point of ', cast(reorderPoint as bigint),
 '.') as detail, _ord, n from risky)"""
ORACLES["stockout_risks"] = with_views(
    f'{_AT_RISK}, {_STOCKOUTS} select type, title, detail, _ord from so', "v_inventory")
_PERIOD_REGION = """mo as (select currency, date_trunc('month', max(date)) as m from v_sales group by currency),
 rg as (select currency, region as dimension_value,
  cast(sum(case when date_trunc('month', date) = m then revenue else 0 end) as double) as current,
  cast(sum(case when date_trunc('month', date) <> m then revenue else 0 end) as double) as previous
  from v_sales join mo using (currency) where date_trunc('month', date) in (m, m - interval 1 month) group by 1, 2)"""


def _hundreds(x: str) -> str:
    return f"printf('%.0f', abs({x} * 100))"


ORACLES["risk_rules"] = with_views(
    f"""{_ALL}, {_RANGE_SKU}, {_PERIOD_REGION},
 g as (select *, row_number() over (partition by currency order by (current - previous) / previous desc, current desc,
  dimension_value) as rn, (current - previous) / previous as d from t where (current - previous) / previous > 0.3),
 dn as (select *, row_number() over (partition by currency order by (current - previous) / previous, current desc,
  dimension_value) as rn, (current - previous) / previous as d from rg
  where previous > 0 and (current - previous) / previous < -0.3),
 h as (select *, row_number() over (partition by currency order by abs(deviation) desc, det, dimension_value, period) as rn
  from found where severity = 'high')
 select currency, 'opportunity' as type, concat(dimension_value, ' demand accelerating') as title,
  concat('Revenue up ', {_hundreds('d')}, '% month-over-month.') as detail from g where rn = 1
 union all select currency, 'risk', concat(dimension_value, ' region demand declining'),
  concat('Revenue down ', {_hundreds('d')}, '% month-over-month.') from dn where rn = 1
 union all select currency, case direction when 'above' then 'opportunity' else 'risk' end,
  concat(metric_label, ' anomaly — ', dimension_value), concat(period_label, ' ', period, ': observed ',
  format('{{:,}}', cast(floor(observed + 0.5) as bigint)), ' vs. an expected ~',
  format('{{:,}}', cast(floor(baseline + 0.5) as bigint)), '.') from h where rn <= 3""", "v_sales", "v_returns")

_PERIOD_SKU = _PERIOD_REGION[_PERIOD_REGION.index("rg as"):].replace("rg as", "sk as").replace("region as", "sku as")
_RISK_FLAGS = (
    f"""{_ALL}, {_AT_RISK}, {_STOCKOUTS}, {_PERIOD_REGION}, {_PERIOD_SKU},
 g as (select *, (current - previous) / previous as d, row_number() over (partition by currency
  order by (current - previous) / previous desc, current desc, dimension_value) as rn from sk
  where previous > 0 and (current - previous) / previous > 0.3),
 dn as (select *, (current - previous) / previous as d, row_number() over (partition by currency
  order by (current - previous) / previous, current desc, dimension_value) as rn from rg
  where previous > 0 and (current - previous) / previous < -0.3),
 h as (select *, row_number() over (partition by currency order by abs(deviation) desc, det, dimension_value, period) as rn
  from found where severity = 'high'),
 every as (
 select null as currency, 0 as rule, n as place, type, title, detail from so where n <= 6
 union all select currency, 1, 1, 'opportunity', concat(dimension_value, ' demand accelerating'),
  concat('Revenue up ', {_hundreds('d')}, '% month-over-month.') from g where rn = 1
 union all select currency, 2, 1, 'risk', concat(dimension_value, ' region demand declining'),
  concat('Revenue down ', {_hundreds('d')}, '% month-over-month.') from dn where rn = 1
 union all select currency, 3, rn, case direction when 'above' then 'opportunity' else 'risk' end,
  concat(metric_label, ' anomaly — ', dimension_value), concat(period_label, ' ', period, ': observed ',
  format('{{:,}}', cast(floor(observed + 0.5) as bigint)), ' vs. an expected ~',
  format('{{:,}}', cast(floor(baseline + 0.5) as bigint)), '.') from h where rn <= 3),
 numbered as (select *, row_number() over (partition by currency order by rule, place) as item from every)
 select currency, cast(item as int) as item, type, title, detail from numbered where item <= 6""")
ORACLES["risk_flags"] = with_views(_RISK_FLAGS, "v_sales", "v_returns", "v_inventory")

# ---- cleaning -------------------------------------------------------------------------------------------------------

_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_DATE_FORMATS = ("['%Y-%m-%d', '%m/%d/%y', '%m/%d/%Y', '%Y/%m/%d', '%b %d, %Y', '%Y-%m-%dT%H:%M:%SZ', '%d-%b-%y', "
                 "'%a, %d %b %Y 00:00:00 GMT', '%B %Y', '%Y-%m-%d %H:%M:%S+00', '%Y-%m-%d 10:30:00 UTC', "
                 "'%a %b %d %Y 00:00:00 GMT+0000 (UTC)', '%m.%d.%Y']")
# Header each canonical field is read from in the raw feeds; fields without one stay blank.
HEADERS = {
    "sales": {"date": "Date", "sku": "SKU", "product": "Product", "region": "Region", "channel": "Channel",
              "units": "Qty", "unitPrice": "Unit Price", "revenue": "Revenue", "currency": "Curr"},
    "orders": {"orderId": "OrderID", "orderDate": "Order Date", "customerId": "CustomerID", "channel": "Channel",
               "region": "Region", "status": "Status", "total": "Total", "currency": "Curr"},
    "inventory": {"sku": "SKU", "productName": "Product Name", "warehouse": "Warehouse", "onHand": "On Hand",
                  "reorderPoint": "Reorder Pt", "unitCost": "Unit Cost"},
    "returns": {"returnId": "ReturnID", "orderId": "OrderID", "sku": "SKU", "returnDate": "Return Date",
                "reason": "Reason", "units": "Units", "refund": "Refund"},
}


def _coerced(dataset: str) -> str:
    """CTEs from raw feed to ``c_<dataset>``: typed values, drop flag, counters and copies of every distinct row."""
    raw_cols = ", ".join(f'"{h}"' for h in HEADERS[dataset].values())
    texts, values, drops, nulls, bad_ones = [], [], [], [], []
    for f in FIELDS[dataset]:
        header = HEADERS[dataset].get(f.key)
        texts.append(f"""{f"trim(\"{header}\", chr(160) || ' ')" if header else "''"} as "{f.key}" """)
        col = f'"{f.key}"'
        bare = f"replace(replace({col}, '$', ''), ',', '')"
        number = f"case when {bare} = '' then '0' when regexp_full_match({bare}, '{_NUMBER}') then {bare} end"
        typed = {"string": col, "number": f"try_cast({number} as double)",
                 "money": f"try_cast({number} as decimal(38,10))",
                 "date": f"case when {col} like '% EST' then cast(try_strptime({col}, '%Y-%m-%d 22:30:00 EST') + interval 1 day as date) "
                         f"when {col} like '% +0530' then cast(try_strptime({col}, '%a, %d %b %Y 05:29:00 +0530') - interval 1 day as date) "
                         f"else cast(try_strptime({col}, {_DATE_FORMATS}) as date) end"}[f.kind]
        default = {"string": "'Unknown'", "number": "0", "money": "0", "date": "null"}[f.kind]
        values.append(f"""case when {col} = '' then {default} else coalesce({typed}, {default}) end as "{f.key}" """)
        wrong = f"({col} <> '' and ({typed}) is null)"
        if f.required:
            drops.append(f"{col} = '' or {wrong}")
        else:
            nulls.append(f"cast({col} = '' as int)")
            bad_ones.append(f"cast({wrong} as int)")
    return f"""r_{dataset} as ({raw_feed_sql(dataset)}),
 d_{dataset} as (select {raw_cols}, min(_ord) as _ord, count(*) as copies from r_{dataset} group by {raw_cols}),
 t_{dataset} as (select {', '.join(texts)}, _ord, copies from d_{dataset}),
 c_{dataset} as (select {', '.join(values)}, _ord, copies, {' or '.join(drops)} as dropped, {' + '.join(nulls)} as nulls,
  {' + '.join(bad_ones)} as bad from t_{dataset})"""


def _counted(dataset: str) -> str:
    return f"""select '{dataset}' as dataset, cast(sum(copies) as bigint) as total_raw_rows,
 cast(sum(copies - 1) as bigint) as duplicates_removed, cast(sum(nulls) as bigint) as nulls_handled,
 count(*) filter (where dropped) as rows_dropped, cast(sum(bad) as bigint) as type_mismatches,
 count(*) filter (where not dropped) as clean_rows from c_{dataset}"""


for _d in FIELDS:
    ORACLES[f"clean_{_d}"] = with_views(
        f"""{_coerced(_d)} select * exclude (copies, dropped, nulls, bad) from c_{_d} where not dropped""", f"v_{_d}")
ORACLES["clean_sales_counts"] = with_views(f"{_coerced('sales')} {_counted('sales')}", "v_sales")
_EACH = "each as (" + " union all ".join(_counted(d) for d in FIELDS) + ")"
_TOTAL = ", ".join(f"cast(sum({c}) as bigint)" for c in (
    "total_raw_rows", "duplicates_removed", "nulls_handled", "rows_dropped", "type_mismatches", "clean_rows"))
ORACLES["cleaning_totals"] = with_views(
    ", ".join(_coerced(d) for d in FIELDS) + f", {_EACH} select * from each union all select 'all', {_TOTAL} from each",
    *(f"v_{d}" for d in FIELDS))
ORACLES["dedupe_count"] = with_views(
    f"""r as ({raw_feed_sql('sales')}), u as (select distinct * exclude (_ord) from r)
 select (select count(*) from r) as total_raw_rows,
 (select count(*) from r) - (select count(*) from u) as duplicates_removed""", "v_sales")


def _blank_rows(dataset: str, columns: dict[str, str], limit: str) -> str:
    raw_cols = ", ".join(f'"{h}"' for h in HEADERS[dataset].values())
    arms = " union all ".join(
        f"""select '{field}' as field, '{header}' as header, count(*) as sampled,
 count(*) filter (where trim("{header}", chr(160) || ' ') = '') as blank from s""" for field, header in columns.items())
    return with_views(f"""r as ({raw_feed_sql(dataset)}),
 s as (select {raw_cols}, min(_ord) as _ord from r group by {raw_cols} {limit}), w as ({arms})
 select field, header, sampled, blank, case when blank = sampled then concat('Blank in all ', sampled,
 ' sampled rows — matching rows will be dropped.') else concat('Blank in ', blank, ' of ', sampled,
 ' sampled rows — those rows will be dropped.') end as warning from w where blank > 0""", f"v_{dataset}")


ORACLES["required_blank_warning"] = _blank_rows(
    "sales", {"date": "Date", "sku": "SKU", "units": "Qty", "revenue": "Revenue"}, "")
ORACLES["required_blank_sample"] = _blank_rows(
    "orders", {"orderId": "OrderID", "orderDate": "Order Date", "total": "Total"}, "order by min(_ord) limit 200")
_cross_reference()
_UPPER = "upper(nullif(currency, '')) as currency"  # the placeholder counts as a currency of its own
ORACLES["clean_currency_breakdown"] = with_views(
    _clean_keys("sales", "orders", "returns") + f""",
 s as (select {_UPPER}, sum(revenue) as revenue, sum(units) as units from k_sales group by 1),
 o as (select {_UPPER}, count(*) as orders from k_orders group by 1),
 r as (select {_UPPER}, count(*) as returns, sum(refund) as refund from k_returns group by 1),
 j as (select currency, cast(coalesce(revenue, 0) as double) as revenue, coalesce(units, 0) as units, coalesce(orders, 0) as orders,
 coalesce(returns, 0) as returns, cast(coalesce(refund, 0) as double) as refund
 from s full join o using (currency) full join r using (currency))
 select * from j where currency is not null""", "v_sales", "v_orders", "v_returns")
ORACLES["clean_dimension_by_currency"] = with_views(
    _clean_keys("sales") + f""", c as (select {_UPPER}, region as dimension_value, sum(revenue) as current from k_sales
 where region <> 'Unknown' group by 1, 2)
 select currency, dimension_value, cast(current as double) as current,
 cast(sum(current) over (partition by currency) as double) as group_total from c""", "v_sales")
ORACLES["feed_roundtrip"] = with_views(
    f"r as ({raw_feed_sql('sales')}) select * exclude (_ord) from r", "v_sales")
ORACLES["feed_line_breaks"] = with_views(
    f"""r as ({raw_feed_sql('sales')}) select * exclude (_ord) replace (case when "Qty" like '%1'
 then concat("Product", chr(10), '"', "Region", '",', chr(10), "Channel") else "Product" end as "Product") from r""", "v_sales")

# ---- header mapping -------------------------------------------------------------------------------------------------

_FIELD_VALUES = ", ".join(
    f"('{d}', {i}, '{f.key}', '{f.label}', '{f.kind}', {str(f.required).lower()}, [{', '.join(repr(a) for a in f.aliases)}])"
    for d, fields in FIELDS.items() for i, f in enumerate(fields))
_CATALOGUE = f"""cat as ({header_catalogue_sql('duckdb')}),
 hd as (select feed, dataset, header, min(header_ord) as header_ord,
  regexp_replace(lower(header), '[^a-z0-9]', '', 'g') as norm,
  list_has_any(string_split_regex(lower(regexp_replace(header, '([a-z])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9]+'),
   ['id', 'no', 'num', 'number', 'code']) as ident from cat group by feed, dataset, header),
 fl as (select * from (values {_FIELD_VALUES}) as f(dataset, field_ord, field, label, kind, required, aliases)),
 sc as (select *, kind = 'string' or not ident as ok,
  list_max(list_transform(aliases, lambda a: 1 - levenshtein(norm, a) / cast(greatest(length(norm), length(a)) as double)))
  as sim from hd join fl using (dataset)),
 cd as (select feed, dataset, field_ord, field, header_ord, header,
  case when list_contains(aliases, norm) then 1
   when ok and len(list_filter(aliases, lambda a: contains(norm, a))) > 0 then 2 else 3 end as stage, sim, ok from sc),
 cand as (select feed, dataset, field_ord, field, header_ord, header, stage,
  case when stage = 3 then sim else 1.0 end as score from cd where stage < 3 or (ok and sim >= 0.8))"""
ORACLES["header_candidates"] = (
    f"with {_CATALOGUE} select feed, dataset, field_ord, field, header_ord, header, stage, round(score, 6) as score from cand")


def _greedy(pinned: bool, tag: str) -> str:
    """One step per field position: the best candidate not used yet, in feeds that have a field there."""
    pin = "feed_no % 3 = 0 and has_sku" if pinned else "false"
    clear = "feed_no % 5 = 0" if pinned else "false"
    out = [f"""{tag}_feeds as (select c.feed, c.dataset, cast(c.feed as bigint) as feed_no, c.dataset <> 'orders' as has_sku,
 min(case when header_ord = 0 then header end) as first_header from cat c group by c.feed, c.dataset),
 {tag}_s0 as (select *, case when {pin} then [first_header] else cast([] as varchar[]) end as used from {tag}_feeds)"""]
    steps = max(len(f) for f in FIELDS.values())
    for i in range(steps):
        out.append(f"""{tag}_p{i} as (select s.feed, s.dataset, s.feed_no, s.has_sku, s.first_header, s.used, f.field,
  arg_min(c.header, row(c.stage, -c.score, c.header_ord)) as free_header,
  arg_min(c.stage, row(c.stage, -c.score, c.header_ord)) as free_stage
  from {tag}_s{i} s left join fl f on f.dataset = s.dataset and f.field_ord = {i}
  left join cand c on c.feed = s.feed and c.field_ord = {i} and not list_contains(s.used, c.header)
  group by all),
 {tag}_c{i} as (select feed, dataset, feed_no, has_sku, first_header, used, field,
  case when {pin} and field = 'sku' then first_header when {clear} and field = 'currency' then null
   else free_header end as header,
  case when {pin} and field = 'sku' then 'manual' when {clear} and field = 'currency' then 'none'
   when free_header is null then 'none' when free_stage = 1 then 'exact' else 'fuzzy' end as match_type from {tag}_p{i}),
 {tag}_s{i + 1} as (select feed, dataset, feed_no, has_sku, first_header,
  case when header is null then used else list_append(used, header) end as used from {tag}_c{i})""")
    union = " union all ".join(
        f"select feed, dataset, {i} as field_ord, field, header, match_type from {tag}_c{i} where field is not null"
        for i in range(steps))
    return ", ".join(out) + f", {tag} as ({union})"


ORACLES["header_mapping"] = f"with {_CATALOGUE}, {_greedy(False, 'auto')} select * from auto"
ORACLES["header_mapping_pinned"] = f"with {_CATALOGUE}, {_greedy(True, 'pins')} select * from pins"
ORACLES["mapping_report"] = f"""with {_CATALOGUE}, {_greedy(False, 'auto')}
 select feed, dataset, 'unmapped header' as issue, header_ord as ord, header as name from cat
 where not exists (select 1 from auto where auto.feed = cat.feed and auto.header = cat.header)
 union all select feed, dataset, 'missing required field', auto.field_ord, label from auto
 join fl using (dataset, field) where required and header is null"""
ORACLES["override_diff"] = f"""with {_CATALOGUE}, {_greedy(False, 'auto')}, {_greedy(True, 'pins')}
 select feed, count(*) filter (where auto.header is distinct from pins.header) as adjusted
 from auto join pins using (feed, field) group by feed"""

# ---- text -----------------------------------------------------------------------------------------------------------

_BLANKS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ' || chr(160)"
ORACLES["note_lines"] = f"""with l as (select doc_id, string_split(text, chr(10)) as parts from documents),
 n as (select doc_id, unnest(range(len(parts))) as line_no, unnest(parts) as raw from l),
 s as (select doc_id, cast(line_no as int) as line_no,
  trim(ltrim(raw, '-*0123456789.)' || {_BLANKS}), {_BLANKS}) as line from n) select * from s where line <> ''"""

ORACLES["summary_coercion"] = f"""with d as (select doc_id, doc_id % 7 as kind, source, lang,
  string_split(text, chr(10)) as lines from documents),
 b as (select *, list_filter(lines, lambda x: trim(x, {_BLANKS}) <> '') as kept from d),
 e as (select doc_id, kind, lines, case when kind = 6 or kind = 5 then '' else concat('About ', source) end as headline,
  case when kind in (3, 6) or len(kept) = 0 then 0 else 1 end as n_sections,
  case when kind in (3, 6) then 0 else len(kept) end as n_bullets,
  case when kind in (3, 6) then 0 else coalesce(list_sum(list_transform(kept, lambda x: length(x))), 0) end as bullet_chars,
  case when kind in (4, 6) then 0 else 1 end as n_recommendations, lang from b)
 select doc_id, headline, n_sections, n_bullets, bullet_chars, n_recommendations,
  case when n_recommendations > 0 then lang end as title, case when n_recommendations > 0 then lines[1] end as detail,
  case when n_recommendations > 0 then case when doc_id % 2 = 0 then 'revenue' else '' end end as related_kpi,
  headline <> '' and n_sections > 0 and n_recommendations > 0 as usable from e"""

# ---- formatted tables and whole reports -----------------------------------------------------------------------------


def _grouped(x: str) -> str:
    return f"format('{{:,}}', cast(floor({x} + 0.5) as bigint))"


def _percent(x: str) -> str:
    return f"concat(printf('%.1f', {x} * 100), '%')"


def _delta_text(x: str) -> str:
    return f"case when {x} is null then 'N/A' when {x} > 0 then concat('+', {_percent(x)}) else {_percent(x)} end"


ORACLES["kpi_formatted"] = with_views(
    kpi_trend_ctes().replace("round(", "(").replace(", 6)", ")") + f"""
 select currency, label, case when current is null then '—'
  when format = 'currency' then concat(case currency when 'USD' then '$' when 'EUR' then '€' else '₹' end,
   {_grouped('current')}) when format = 'percent' then {_percent('current')} else {_grouped('current')} end as current_text,
 {_delta_text('mom')} as mom_text, {_delta_text('qoq')} as qoq_text, {_delta_text('yoy')} as yoy_text,
 case when kpi <> 'avgMargin' and mom is null then 'No prior-period data in your upload to compare against.' end as caveat,
 case when mom is null or mom = 0 then 'neutral' when (mom > 0) = (kpi <> 'returnRate') then 'good' else 'bad' end
  as polarity from kpis""", "v_sales", "v_orders", "v_returns", "v_inventory")

def _unpivot(section: str, source: str, number: str, cells: dict[str, str]) -> str:
    return " union all ".join(f"select '{section}' as section, cast({number} as int) as row_no, '{c}' as cell, {x} as text from {source}"
                              for c, x in cells.items())


_AMOUNT = f"concat(case currency when 'USD' then '$' when 'EUR' then '€' else '₹' end, {_grouped('current')})"
_SELLER = {"dimension_value": "dimension_value", "revenue": _AMOUNT, "trend": f"concat({_delta_text('d')}, ' MoM')"}
ORACLES["export_cells"] = with_views(
    kpi_trend_ctes().replace("round(", "(").replace(", 6)", ")") + f""", {_AT_RISK}, {_STOCKOUTS},
 best as (select currency from v_sales group by 1 order by count(*) desc, min(_ord) limit 1),
 kb as (select *, list_position(['revenue', 'units', 'orders', 'returnRate', 'avgMargin'], kpi) - 1 as kpi_ord from kpis join best using (currency)),
 t as (select currency, sku as dimension_value, {_performer_cols("date_trunc('month', date) = m", "date_trunc('month', date) = m - interval 1 month")}
  from v_sales join anchors using (currency) join best using (currency) where date_trunc('month', date) in (m, m - interval 1 month) group by 1, 2),
 n as (select *, (current - previous) / previous as d, row_number() over (order by current desc, dimension_value) as up,
  row_number() over (order by current, dimension_value desc) as down from t),
 hi as (select * from n where up <= 5), lo as (select * from n where down <= 5), so6 as (select * from so where n <= 6)
 {_unpivot('kpis', 'kb', 'kpi_ord', {'label': 'label', 'current': f"case when current is null then '—' when format = 'currency' then {_AMOUNT} when format = 'percent' then {_percent('current')} else {_grouped('current')} end", **{c: _delta_text(c) for c in ('mom', 'qoq', 'yoy')}})}
 union all {_unpivot('top_performers', 'hi', 'up', _SELLER)} union all {_unpivot('bottom_performers', 'lo', 'down', _SELLER)}
 union all {_unpivot('risks', 'so6', 'n', {c: c for c in ('type', 'title', 'detail')})}""", "v_sales", "v_orders", "v_returns", "v_inventory")

_UNROUNDED = _ALL.replace("round(value, 6)", "value").replace("round(m, 6)", "m").replace("round(z, 6)", "z").replace(
    "round(base, 6)", "base").replace("round(dev, 6)", "dev")
ORACLES["anomaly_captions"] = with_views(
    _UNROUNDED + f""" select currency, id, case method when 'zscore' then concat('z = ', printf('%.1f', deviation))
  else concat(case when deviation > 0 then '+' else '' end, printf('%.0f', deviation * 100), '% vs. trailing avg') end
  as deviation_text, case method when 'zscore' then 'z-score method, threshold 2.5'
  else 'rolling 3-month baseline, threshold 25%' end as method_text,
 {_grouped('observed')} as observed_text, {_grouped('baseline')} as baseline_text from found""", "v_sales", "v_returns")

ORACLES["report_labels"] = with_views(
    """best as (select currency from v_sales group by 1 order by count(*) desc, min(_ord) limit 1),
 a as (select max(date) as hi from v_sales join best using (currency))
 select strftime(hi, '%b %Y') as period_label, 'MoM' as comparison_label, strftime(hi, '%Y-%m') as anchor_month,
 currency as effective_currency, (select count(distinct currency) from v_sales) > 1 as several_currencies
 from a, best""", "v_sales")

_SCOPED = "currency = 'INR' and channel = '2-HIGH'"


def _scoped_sums(tag: str, span: tuple[str, str]) -> str:
    return f"""{tag} as (select cast(sum(revenue) as double) as revenue, sum(units) as units, count(*) as n,
 (select cast(count(*) as double) from v_orders {_between('orderDate', *span)} and {_SCOPED}) as orders,
 cast(sum(revenue) - sum(cast(units as decimal(18,4)) * unitCost) as double) / cast(sum(revenue) as double) as avgMargin
 from v_sales left join costs using (sku) {_between('date', *span)} and {_SCOPED})"""


ORACLES["report_channel_kpis"] = with_views(
    f"{_COST}, {_scoped_sums('cur', _R)}, {_scoped_sums('prev', _P)}, k as (" + " union all ".join(
        f"select '{k}' as kpi, round(cur.{k}, 6) as current, round((cur.{k} - prev.{k}) / prev.{k}, 6) as mom from cur, prev"
        for k in ("revenue", "units", "orders", "avgMargin")) + """
 union all select 'returnRate', null, null)
 select kpi, current, mom, case when kpi = 'returnRate' then concat('Your Returns data isn''t tagged by channel, so ',
 'return rate can''t be scoped to "2-HIGH" — it would wrongly divide all-channel returns by one channel''s units.') end
 as caveat, case when mom is null or mom = 0 then 'neutral' when mom > 0 then 'good' else 'bad' end as polarity from k""",
    "v_sales", "v_orders", "v_inventory")

def _open_sums(tag: str, start: str, end: str) -> str:
    return _scoped_sums(tag, (start, end)).replace(f"date '{start}'", start).replace(f"date '{end}'", end)


_OPEN = f"(select max(date) from v_sales) - date '{_R[0]}'"
_BEFORE = (f"cast(date '{_R[0]}' - cast(({_OPEN}) + 1 as integer) as date)", f"cast(date '{_R[0]}' - 1 as date)")
ORACLES["report_open_range_kpis"] = with_views(
    f"{_COST}, {_open_sums('cur', f'cast({chr(39)}{_R[0]}{chr(39)} as date)', '(select max(date) from v_sales)')}, "
    f"{_open_sums('prev', *_BEFORE)}, k as (" + " union all ".join(
        f"select '{k}' as kpi, round(cur.{k}, 6) as current, round((cur.{k} - prev.{k}) / prev.{k}, 6) as mom from cur, prev"
        for k in ("revenue", "units", "orders", "avgMargin")) + """
 union all select 'returnRate', null, null) select * from k""", "v_sales", "v_orders", "v_inventory")

ORACLES["report_bundle"] = with_views(
    f"""best as (select currency from v_sales group by 1 order by count(*) desc, min(_ord) limit 1),
 mo as (select date_trunc('month', max(date)) as m from v_sales join best using (currency)),
 p as (select count(distinct sku) as n from v_sales join best using (currency), mo
  where date_trunc('month', date) in (m, m - interval 1 month)),
 {_CWEEKS}, {_CRETURNS}, {_REGION_MONTHS}, f as (
  select count(*) as n from (select id from ({zscore_sql('cw', 'week', *_W, by=_BY_CURRENCY)}) join best using (currency)
  union all select id from ({zscore_sql('cr', 'month', *_M, by=_BY_CURRENCY)}) join best using (currency)
  union all select id from ({rolling_sql('gm')}) join best using (currency)))
 select 'summary' as section, 6 as n_rows union all select 'kpis', 5 union all select 'risks', 6
 union all select 'anomalies', least(n, 15) from f
 union all select 'top_performers', least(n, 5) from p union all select 'bottom_performers', least(n, 5) from p
 union all select 'dataset_sales', count(*) from v_sales union all select 'dataset_orders', count(*) from v_orders
 union all select 'dataset_inventory', count(*) from v_inventory
 union all select 'dataset_returns', count(*) from v_returns""", "v_sales", "v_orders", "v_inventory", "v_returns")


def _scoped(body: str, returns_of: str) -> str:
    """``body`` over views whose currency is ``currency|channel``, ``*`` for all channels; returns as ``returns_of`` says."""
    views = [f"b_sales as ({VIEWS['v_sales']})", f"b_orders as ({VIEWS['v_orders']})",
             f"b_returns as ({VIEWS['v_returns'].replace('from v_sales', 'from b_sales')})", f"v_inventory as ({VIEWS['v_inventory']})",
             "scopes as (select distinct currency, channel from b_sales union select distinct currency, '*' from b_sales)",
             *(f"v_{n} as (select * replace (currency || '|*' as currency) from b_{n} union all "
               f"select * replace (currency || '|' || channel as currency) from b_{n})" for n in ("sales", "orders")),
             f"v_returns as ({returns_of})"]
    return f"with {', '.join(views)}, {body}"


_SCOPE_NAMES = "split_part(currency, '|', 1) as currency, split_part(currency, '|', 2) as channel"
ORACLES["report_all_scopes"] = _scoped(
    kpi_trend_ctes() + f""", c as (select {_SCOPE_NAMES}, anchor_month, kpi, current, mom, qoq, yoy from kpis),
 h as (select * replace (case when kpi <> 'returnRate' or channel = '*' then current end as current,
  case when kpi <> 'returnRate' or channel = '*' then mom end as mom, case when kpi <> 'returnRate' or channel = '*' then qoq end as qoq,
  case when kpi <> 'returnRate' or channel = '*' then yoy end as yoy) from c)
 select *, case when kpi = 'returnRate' and channel <> '*' then concat('Your Returns data isn''t tagged by channel, so ',
  'return rate can''t be scoped to "', channel, '" — it would wrongly divide all-channel returns by one channel''s units.')
  when kpi <> 'avgMargin' and mom is null then 'No prior-period data in your upload to compare against.' end as caveat,
 case when mom is null or mom = 0 then 'neutral' when (mom > 0) = (kpi <> 'returnRate') then 'good' else 'bad' end as polarity
 from h""", "select * replace (currency || '|*' as currency) from b_returns")
ORACLES["report_all_scopes_risks"] = _scoped(
    _RISK_FLAGS.replace("select currency, cast(item as int)", f"select {_SCOPE_NAMES}, cast(item as int)"),
    "select b_returns.* replace (b_returns.currency || '|' || scopes.channel as currency) from b_returns join scopes using (currency)")


def _scope_sql(name: str, span: tuple[str, str] | None = None, channel: str = "", currency: str = "", display: bool = False) -> str:
    start, end = (f"date '{span[0]}'", f"date '{span[1]}'") if span else ("cast(date_trunc('month', hi) as date)", "last_day(hi)")
    in_view = "{d} between (select d0 from b) and (select d1 from b)"
    found = " or ".join(f"exists (select 1 from v_{n} where channel = '{channel}' and {in_view.format(d=d)})"
                        for n, d in (("sales", "date"), ("orders", "orderDate")))
    judged = " union ".join(f"select currency from v_{n}, ch where {'true' if n == 'returns' else '(ch is null or channel = ch)'}"
                            + (f" and {in_view.format(d=d)}" if display else "")
                            for n, d in (("sales", "date"), ("orders", "orderDate"), ("returns", "returnDate")))
    chosen = f"'{currency}'" if currency else "null"
    anchor = "cast(null as date)" if span else """(select cast(date_trunc('month', max(date)) as date) from v_sales, ch, cu
  where (ch is null or channel = ch) and (cu is null or currency = cu))"""
    return f"""select * from (with b as (select lo, hi, {start} as d0, {end} as d1 from (select min(date) as lo, max(date) as hi from v_sales)),
 ch as (select case when {found} then '{channel}' end as ch), jd as ({judged}),
 mj as (select currency from v_sales, ch where (ch is null or channel = ch) {('and ' + in_view.format(d='date')) if display else ''}
  group by 1 order by count(*) desc, min(_ord) limit 1),
 cu as (select case when (select count(*) from jd) > 1 then coalesce({chosen}, (select currency from mj)) end as cu)
 select '{name}' as scope, lo as data_start, hi as data_end, d0 as display_start, d1 as display_end, ch as channel, cu as currency,
 (select count(*) from jd) > 1 as several_currencies, {anchor} as anchor from b, ch, cu)"""


ORACLES["report_scopes"] = with_views("all_of as (" + " union all ".join([
    _scope_sql("nothing picked"), _scope_sql("range, currencies of its display", _R, display=True), _scope_sql("channel", None, "2-HIGH"),
    _scope_sql("range, channel and currency", _R, "2-HIGH", "INR"), _scope_sql("channel that does not occur", None, "none", "EUR"),
]) + ") select * from all_of", "v_sales", "v_orders", "v_returns")

# ---- synthetic feeds ------------------------------------------------------------------------------------------------

_MONTH_FACTOR = "case month(date) " + " ".join(f"when {m} then {f}" for m, f in SEASON.items()) + " else 1.0 end"
ORACLES["synthetic_volume"] = f"""
with p as (select cast(count(*) as double) / 100 as base from part),
 d as (select r_name as region, 0.75::double + 0.1::double * r_regionkey as weight, cast(day as date) as date
  from region, (select unnest(generate_series(date '2025-04-01', date '2026-06-30', interval 1 day)) as day)),
 v as (select region, date, floor(base * weight * case when dayofweek(date) in (0, 6) then {WEEKEND}::double else 1.0 end
  * cast({_MONTH_FACTOR} as double) * (1::double + ((year(date) - 2025) * 12 + month(date) - 4) * {GROWTH}::double) + 0.5) as n from d, p)
select region, date, cast(n as bigint) as n_lines from v where n > 0"""
