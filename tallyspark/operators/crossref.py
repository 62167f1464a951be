"""Key reconciliation between feeds: which keys of one feed are missing from another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import UNKNOWN

# Label and wording of the checks.
CHECKS = {
    "sales_inventory": (
        "Sales SKUs vs. inventory",
        "All %d SKUs sold have a matching inventory record.",
        "%d of %d SKUs sold have no matching inventory record."),
    "returns_orders": (
        "Return order IDs vs. orders",
        "All %d returns matched a known order.",
        "%d of %d returns reference an order ID not found in Orders."),
    "returns_sales": (
        "Return SKUs vs. sales",
        "All %d returned SKUs matched a sales record.",
        "%d of %d returned SKUs have no matching sales record."),
}
SKIPPED = ("Cross-reference skipped", "Upload more than one dataset to enable cross-file checks.")


def _keys(df: DataFrame, key: str, keep_placeholder: bool) -> DataFrame:
    keys = df.filter(F.col(key).isNotNull() & (F.col(key) != "")).select(F.col(key).alias("key"))
    return keys if keep_placeholder else keys.filter(F.col("key") != UNKNOWN)


def key_presence(left: DataFrame, right: DataFrame, key: str, keep_placeholder: bool = False) -> DataFrame:
    """Distinct keys of ``left`` with whether ``right`` has them.

    Both feeds go through one map-side combined aggregation on the key, so a key repeated a billion times is one row per
    task when it is shuffled.
    """
    tagged = (
        _keys(left, key, keep_placeholder).withColumn("l", F.lit(1)).withColumn("r", F.lit(0))
        .unionByName(_keys(right, key, keep_placeholder).withColumn("l", F.lit(0)).withColumn("r", F.lit(1)))
    )
    return (
        tagged.groupBy("key").agg(F.max("l").alias("l"), F.max("r").alias("r"))
        .filter(F.col("l") == 1).select("key", (F.col("r") == 1).alias("matched"))
    )


def unmatched_keys(left: DataFrame, right: DataFrame, key: str, keep_placeholder: bool = False) -> DataFrame:
    return key_presence(left, right, key, keep_placeholder).filter(~F.col("matched")).select("key")


def match_counts(left: DataFrame, right: DataFrame, key: str, keep_placeholder: bool = False) -> DataFrame:
    """One row: distinct keys on the left and how many of them the right side lacks."""
    return key_presence(left, right, key, keep_placeholder).agg(
        F.count(F.lit(1)).alias("keys"), F.count_if(~F.col("matched")).alias("unmatched"))


def _sentence(check: str) -> Column:
    _, clean, broken = CHECKS[check]
    return F.when(F.col("unmatched") == 0, F.format_string(clean, "keys")).otherwise(
        F.format_string(broken, "unmatched", "keys"))


def cross_reference(sales: DataFrame | None, orders: DataFrame | None, inventory: DataFrame | None,
                    returns: DataFrame | None, keep_placeholder: bool = False) -> DataFrame:
    """One row per possible check, in fixed order; a single ``skipped`` row when no two feeds can be compared."""
    pairs = [("sales_inventory", sales, inventory, "sku"), ("returns_orders", returns, orders, "orderId"),
             ("returns_sales", returns, sales, "sku")]
    report = None
    for i, (check, left, right, key) in enumerate(pairs):
        if left is None or right is None:
            continue
        row = match_counts(left, right, key, keep_placeholder).select(
            F.lit(i).alias("check_ord"), F.lit(CHECKS[check][0]).alias("label"), _sentence(check).alias("detail"),
            (F.col("unmatched") == 0).alias("clean"))
        report = row if report is None else report.unionByName(row)
    if report is not None:
        return report
    given = next(df for df in (sales, orders, inventory, returns) if df is not None)
    return given.sparkSession.range(1).select(
        F.lit(0).alias("check_ord"), F.lit(SKIPPED[0]).alias("label"), F.lit(SKIPPED[1]).alias("detail"),
        F.lit(True).alias("clean"))
