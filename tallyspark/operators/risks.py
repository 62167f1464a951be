"""Inventory at risk and the rule-based list of risks and opportunities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fmt import fixed, format_number, plain_number
from ..sources.schema import ORD, UNKNOWN
from .anomalies import strongest
from .ranking import top_k

# Momentum needed for a growth or decline flag, high anomalies quoted, entries in the list.
MOMENTUM = 0.3
HIGH_ANOMALIES = 3
LIST_CAP = 6


def at_risk(inventory: DataFrame) -> DataFrame:
    return inventory.filter((F.col("reorderPoint") > 0) & (F.col("onHand") <= F.col("reorderPoint")))


def _named(column: str) -> Column:
    """A cleaned text column with its blank placeholder taken for missing."""
    return F.when((F.col(column) != "") & (F.col(column) != UNKNOWN), F.col(column))


def _stock_label() -> Column:
    return F.coalesce(_named("productName"), _named("sku"), F.lit("Unknown SKU"))


def _gap_order() -> list[Column]:
    return [F.col("gap"), F.col(ORD), F.col("label"), F.col("warehouse")]


def inventory_risk(inventory: DataFrame) -> DataFrame:
    """Stock at or below its reorder point, worst gap first."""
    return at_risk(inventory).select(
        _stock_label().alias("label"), "onHand", "reorderPoint",
        F.coalesce(_named("warehouse"), F.lit("Unspecified warehouse")).alias("warehouse"),
        (F.col("onHand") - F.col("reorderPoint")).alias("gap"), ORD).orderBy(*_gap_order())


def worst_gaps(inventory: DataFrame, k: int = 8) -> DataFrame:
    return top_k(inventory_risk(inventory), k, _gap_order())


def stockout_risks(inventory: DataFrame) -> DataFrame:
    """One flag per stock row at risk, in file order (``_ord``)."""
    return at_risk(inventory).select(
        F.lit("risk").alias("type"), F.concat(F.lit("Stockout risk: "), _stock_label()).alias("title"),
        F.concat(plain_number(F.col("onHand")), F.lit(" units on hand at "),
                 F.coalesce(_named("warehouse"), F.lit("an unspecified warehouse")),
                 F.lit(" vs. a reorder point of "), plain_number(F.col("reorderPoint")), F.lit(".")).alias("detail"),
        ORD)


def growth_opportunity(performers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    best = top_k(performers.filter(F.col("delta_pct") > MOMENTUM), 1,
                 [F.col("delta_pct").desc(), F.col("current").desc(), F.col("dimension_value")], by)
    return best.select(
        *by, F.lit("opportunity").alias("type"),
        F.concat(F.col("dimension_value"), F.lit(" demand accelerating")).alias("title"),
        F.concat(F.lit("Revenue up "), fixed(F.col("delta_pct") * 100, 0), F.lit("% month-over-month.")).alias("detail"))


def declining_region(performers: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    worst = top_k(performers.filter(F.col("delta_pct") < -MOMENTUM), 1,
                  [F.col("delta_pct"), F.col("current").desc(), F.col("dimension_value")], by)
    return worst.select(
        *by, F.lit("risk").alias("type"),
        F.concat(F.col("dimension_value"), F.lit(" region demand declining")).alias("title"),
        F.concat(F.lit("Revenue down "), fixed(F.abs(F.col("delta_pct") * 100), 0),
                 F.lit("% month-over-month.")).alias("detail"))


def high_anomaly_flags(anomalies: DataFrame, k: int = HIGH_ANOMALIES, by: tuple[str, ...] = ()) -> DataFrame:
    top = strongest(anomalies.filter(F.col("severity") == "high"), k, by)
    return top.select(
        *by, F.when(F.col("direction") == "above", "opportunity").otherwise("risk").alias("type"),
        F.concat(F.col("metric_label"), F.lit(" anomaly — "), F.col("dimension_value")).alias("title"),
        F.concat(F.col("period_label"), F.lit(" "), F.col("period"), F.lit(": observed "),
                 format_number(F.col("observed")), F.lit(" vs. an expected ~"), format_number(F.col("baseline")),
                 F.lit(".")).alias("detail"),
        F.col("rank").cast("bigint").alias("within_ord"))


def risk_flags(inventory: DataFrame | None, sku_performers: DataFrame, region_performers: DataFrame,
               anomalies: DataFrame, cap: int = LIST_CAP, by: tuple[str, ...] = ()) -> DataFrame:
    """Stockouts in file order, then the growth, decline and anomaly rules, cut to ``cap`` entries.

    Stockouts come first, so only the first ``cap`` of them can make the list: every rule is cut before the union and the
    final numbering sees a handful of rows. With ``by`` each scope has its list; stock belongs to none, so stockouts are then
    a list of their own with a null scope.
    """
    rules = [growth_opportunity(sku_performers, by).withColumn("within_ord", F.lit(0).cast("bigint")),
             declining_region(region_performers, by).withColumn("within_ord", F.lit(0).cast("bigint")),
             high_anomaly_flags(anomalies, by=by)]
    if inventory is not None:
        first = top_k(stockout_risks(inventory), cap, [F.col(ORD), F.col("title"), F.col("detail")])
        rules.insert(0, first.select("type", "title", "detail", F.col("rank").cast("bigint").alias("within_ord")))
    merged = None
    for i, rule in enumerate(rules):
        rule = rule.withColumn("rule_ord", F.lit(i))
        merged = rule if merged is None else merged.unionByName(rule, allowMissingColumns=True)
    order = (W.partitionBy(*by) if by else W).orderBy("rule_ord", "within_ord")
    return merged.withColumn("item", F.row_number().over(order)).filter(F.col("item") <= cap).select(
        *by, "item", "type", "title", "detail")
