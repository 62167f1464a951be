"""Series outliers by z-score, interquartile range and rolling baseline; ranking, scoping and drill-down of what they flag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import GRAIN_START, period_end, period_key
from ..sources.schema import ORD
from ..spark_tools import small_side
from .buckets import bucket, quartile_stats, spread_stats, trailing_mean
from .ranking import top_k
from .scoping import DateRange, by_columns
from .skew import skew_join

# Thresholds of each detector at each sensitivity, the shortest series worth judging, the severity margins,
# and the metric labels with the word that introduces their period.
THRESHOLDS = {
    "zscore": {"strict": 3.5, "standard": 2.5, "lenient": 1.75},
    "iqr": {"strict": 3.0, "standard": 1.5, "lenient": 0.75},
    "rolling-baseline": {"strict": 0.4, "standard": 0.25, "lenient": 0.15},
}
MIN_SERIES = 6
Z_HIGH_MARGIN = 1.5
ROLLING_HIGH_FACTOR = 1.6
WEEKLY_UNITS = ("Weekly units sold", "week of")
MONTHLY_RETURNS = ("Monthly returned units", "in")
MONTHLY_REVENUE = ("Monthly revenue", "in")
PICKS_PER_METRIC = (("Monthly revenue", 2), ("Weekly units sold", 2), ("Monthly returned units", 1))

Thresholds = float | dict[str, float]


def _with_thresholds(df: DataFrame, thresholds: Thresholds) -> DataFrame:
    """A ``threshold`` column; with several named thresholds each row is judged once per name (``sensitivity``)."""
    if not isinstance(thresholds, dict):
        return df.withColumn("threshold", F.lit(float(thresholds)))
    levels = F.array(*[F.struct(F.lit(k).alias("sensitivity"), F.lit(float(t)).alias("threshold"))
                       for k, t in thresholds.items()])
    return df.select("*", F.inline(levels))


def _loosest(thresholds: Thresholds) -> float:
    return min(thresholds.values()) if isinstance(thresholds, dict) else float(thresholds)


def _records(df: DataFrame, by: tuple[str, ...], method: str, suffix: str, dim_type: str, grain: str,
             metric: tuple[str, str], baseline: Column, deviation: Column, high: Column, above: Column) -> DataFrame:
    period = period_key(grain, F.col("start"))
    named = ["sensitivity"] if "sensitivity" in df.columns else []
    return df.select(
        *by, *named,
        F.concat_ws(":", F.lit(dim_type), F.col("dimension_value"), period, F.lit(suffix)).alias("id"),
        F.lit(method).alias("method"), F.col("threshold"), F.lit(dim_type).alias("dimension_type"),
        F.col("dimension_value"), F.lit(metric[0]).alias("metric_label"), F.lit(metric[1]).alias("period_label"),
        period.alias("period"), F.col("start").alias("span_start"),
        period_end(grain, F.col("start")).alias("span_end"), F.col("value").alias("observed"),
        baseline.alias("baseline"), deviation.alias("deviation"),
        F.when(high, "high").otherwise("medium").alias("severity"),
        F.when(above, "above").otherwise("below").alias("direction"), F.col("n_rows"),
    )


def zscore_outliers(buckets: DataFrame, thresholds: Thresholds, dim_type: str, grain: str, metric: tuple[str, str],
                    by: tuple[str, ...] = ()) -> DataFrame:
    stats = spread_stats(buckets, by, MIN_SERIES).filter(F.col("sd") != 0)
    scored = stats.withColumn("z", (F.col("value") - F.col("mean")) / F.col("sd"))
    size = F.abs("z")
    flagged = _with_thresholds(scored.filter(size >= _loosest(thresholds)), thresholds)
    flagged = flagged.filter(size >= F.col("threshold"))
    return _records(flagged, by, "zscore", "zscore", dim_type, grain, metric, F.col("mean"), F.col("z"),
                    size >= F.col("threshold") + Z_HIGH_MARGIN, F.col("z") >= 0)


def iqr_outliers(buckets: DataFrame, thresholds: Thresholds, dim_type: str, grain: str, metric: tuple[str, str],
                 by: tuple[str, ...] = ()) -> DataFrame:
    stats = quartile_stats(buckets, by).withColumn("iqr", F.col("q3") - F.col("q1"))
    stats = stats.filter((F.col("n") >= MIN_SERIES) & (F.col("iqr") != 0))
    value, iqr = F.col("value"), F.col("iqr")

    def lower(t: Column) -> Column:
        return F.col("q1") - t * iqr

    def upper(t: Column) -> Column:
        return F.col("q3") + t * iqr

    loosest = F.lit(_loosest(thresholds))
    flagged = _with_thresholds(stats.filter((value < lower(loosest)) | (value > upper(loosest))), thresholds)
    t = F.col("threshold")
    flagged = flagged.filter((value < lower(t)) | (value > upper(t)))
    middle = (F.col("q1") + F.col("q3")) / 2
    return _records(flagged, by, "iqr", "iqr", dim_type, grain, metric, middle, (value - middle) / iqr,
                    (value > upper(t) + iqr) | (value < lower(t) - iqr), value >= upper(t))


def rolling_baseline(buckets: DataFrame, thresholds: Thresholds, dim_type: str = "region", grain: str = "month",
                     metric: tuple[str, str] = MONTHLY_REVENUE, window: int = 3, by: tuple[str, ...] = ()) -> DataFrame:
    based = trailing_mean(buckets, window, by).filter(F.col("baseline") != 0)
    shifted = based.withColumn("shift", (F.col("value") - F.col("baseline")) / F.col("baseline"))
    size = F.abs("shift")
    flagged = _with_thresholds(shifted.filter(size >= _loosest(thresholds)), thresholds)
    flagged = flagged.filter(size >= F.col("threshold"))
    return _records(flagged, by, "rolling-baseline", "rolling", dim_type, grain, metric, F.col("baseline"),
                    F.col("shift"), size >= F.col("threshold") * ROLLING_HIGH_FACTOR, F.col("shift") >= 0)


_SERIES_DETECTORS = {"zscore": zscore_outliers, "iqr": iqr_outliers}


def sku_week_units(sales: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return bucket(sales, "date", "week", "units", "sku", by)


def sku_month_returns(returns: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return bucket(returns, "returnDate", "month", "units", "sku", by)


def region_month_revenue(sales: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    return bucket(sales, "date", "month", "revenue", "region", by)


def sku_unit_anomalies(sales: DataFrame, method: str, thresholds: Thresholds, by: tuple[str, ...] = ()) -> DataFrame:
    return _SERIES_DETECTORS[method](sku_week_units(sales, by), thresholds, "sku", "week", WEEKLY_UNITS, by)


def sku_return_anomalies(returns: DataFrame, method: str, thresholds: Thresholds,
                         by: tuple[str, ...] = ()) -> DataFrame:
    return _SERIES_DETECTORS[method](sku_month_returns(returns, by), thresholds, "sku", "month", MONTHLY_RETURNS, by)


def region_revenue_anomalies(sales: DataFrame, thresholds: Thresholds, window: int = 3,
                             by: tuple[str, ...] = ()) -> DataFrame:
    return rolling_baseline(region_month_revenue(sales, by), thresholds, window=window, by=by)


def detect_anomalies(sales: DataFrame, returns: DataFrame | None, method: str = "zscore", sensitivity: str = "standard",
                     by: tuple[str, ...] = ()) -> DataFrame:
    """All three detectors at one sensitivity, with ``detector_ord`` keeping their order for tie-breaks."""
    level = THRESHOLDS[method][sensitivity]
    found = [sku_unit_anomalies(sales, method, level, by)]
    if returns is not None:
        found.append(sku_return_anomalies(returns, method, level, by))
    found.append(region_revenue_anomalies(sales, THRESHOLDS["rolling-baseline"][sensitivity], by=by))
    merged = None
    for df in found:
        ord_ = F.when(F.col("metric_label") == WEEKLY_UNITS[0], 0).when(
            F.col("metric_label") == MONTHLY_RETURNS[0], 1).otherwise(2)
        df = df.withColumn("detector_ord", ord_)
        merged = df if merged is None else merged.unionByName(df)
    return merged


def strength_order() -> list[Column]:
    """Strongest deviation first; equal ones by detector, dimension and period."""
    return [F.abs("deviation").desc(), F.col("detector_ord"), F.col("dimension_value"), F.col("period")]


def ranked(anomalies: DataFrame) -> DataFrame:
    return anomalies.orderBy(*strength_order())


def strongest(anomalies: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    return top_k(anomalies, k, strength_order(), by)


def overlapping(anomalies: DataFrame, span: DateRange | None) -> DataFrame:
    if span is None:
        return anomalies
    return anomalies.filter((F.col("span_start") <= F.lit(span[1])) & (F.col("span_end") >= F.lit(span[0])))


def pick_by_metric(anomalies: DataFrame, by: tuple[str, ...] = (), total: int = 5) -> DataFrame:
    """The strongest few of every metric, since deviations of different metrics are not comparable."""
    cap = F.lit(0)
    place = F.lit(len(PICKS_PER_METRIC))
    for i, (label, k) in enumerate(PICKS_PER_METRIC):
        cap = F.when(F.col("metric_label") == label, k).otherwise(cap)
        place = F.when(F.col("metric_label") == label, i).otherwise(place)
    most = max(k for _, k in PICKS_PER_METRIC)
    best = top_k(anomalies, most, strength_order(), (*by, "metric_label"), "metric_rank").filter(F.col("metric_rank") <= cap)
    picked = best.withColumn("metric_ord", place)
    order = W.partitionBy(*by).orderBy("metric_ord", "metric_rank")
    return picked.withColumn("pick", F.row_number().over(order)).filter(F.col("pick") <= total)


def month_markers(anomalies: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Strongest rolling-baseline anomaly of every month."""
    rolling = anomalies.filter(F.col("method") == "rolling-baseline")
    order = [F.abs("deviation").desc(), F.col("dimension_value")]
    return top_k(rolling, 1, order, (*by, "period"), "marker_rank").drop("marker_rank")


def trend_with_markers(trend: DataFrame, anomalies: DataFrame, span: DateRange | None = None,
                       by: tuple[str, ...] = ()) -> DataFrame:
    """Monthly revenue with the month's strongest regional shift and, for a range, whether the month is highlighted.

    The highlight shows only if the months of both range ends are in the series.
    """
    marks = month_markers(anomalies, by).select(
        *by, F.col("period").alias("month"), F.col("id").alias("anomaly_id"),
        F.col("dimension_value").alias("anomaly_region"), F.col("deviation").alias("anomaly_deviation"))
    joined = trend.join(marks, [*by, "month"], "left")
    if span is None:
        return joined.withColumn("highlighted", F.lit(False))
    first, last = span[0].strftime("%Y-%m"), span[1].strftime("%Y-%m")
    whole = W.partitionBy(*by)
    shown = (F.max(F.when(F.col("month") == first, 1)).over(whole) == 1) & (
        F.max(F.when(F.col("month") == last, 1)).over(whole) == 1)
    return joined.withColumn("highlighted", F.coalesce(shown & F.col("month").between(first, last), F.lit(False)))


def drill_down(source: DataFrame, date_column: str, grain: str, dim: str, anomalies: DataFrame,
               columns: list[str], sample: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """First ``sample`` source rows behind each anomaly in file order; ``n_rows`` tells how many there are in all.

    Each task keeps only its own first ``sample`` rows per anomaly before the shuffle. Anomalies beyond the broadcast bound
    meet the rows in a shuffle join that splits the SKU-weeks holding much of the feed.
    """
    wanted = anomalies.select(*by, "id", F.col("dimension_value").alias("_dim"), F.col("span_start").alias("_start"), "n_rows")
    small = small_side(wanted)
    rows = source.select(*by_columns(source, by), *[c for c in source.columns if c not in by])
    rows = rows.withColumn("_start", GRAIN_START[grain](F.col(date_column))).withColumn("_dim", F.col(dim))
    keys = [*by, "_dim", "_start"]
    joined = rows.join(small, keys) if small is not wanted else skew_join(rows, wanted, keys)
    order = [F.col(ORD), *[F.col(c) for c in columns]]
    return top_k(joined, sample, order, (*by, "id"), "row_no").select(*by, "id", "n_rows", "row_no", *columns)
