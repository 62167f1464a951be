"""Per-currency tables. Amounts of different currencies are never added up; currency is always a grouping key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import ORD, UNKNOWN
from .scoping import count_rows, currency_code, real_dimension, row_weight

NO_CURRENCY = UNKNOWN.upper()
SALTS = 64


def _present(*feeds: DataFrame | None) -> list[DataFrame]:
    return [f for f in feeds if f is not None]


def available_currencies(*feeds: DataFrame | None, include_unknown: bool = True) -> DataFrame:
    """Distinct upper-case currencies over all feeds. The placeholder counts as one unless told otherwise."""
    codes = None
    for feed in _present(*feeds):
        part = feed.select(currency_code(F.col("currency")).alias("currency"))
        codes = part if codes is None else codes.union(part)
    codes = codes.filter(F.col("currency").isNotNull())
    if not include_unknown:
        codes = codes.filter(F.col("currency") != NO_CURRENCY)
    return codes.distinct().orderBy("currency")


def default_currency(sales: DataFrame) -> DataFrame:
    """The currency of most sales rows (one row or none); the first seen wins a tie."""
    code = currency_code(F.col("currency"))
    return (
        sales.filter(code.isNotNull() & (code != NO_CURRENCY))
        .groupBy(code.alias("currency"))
        .agg(count_rows(sales).alias("n_rows"), F.min(ORD).alias("_first"))
        .orderBy(F.col("n_rows").desc(), "_first", "currency").limit(1)
        .select("currency", "n_rows")
    )


def currency_breakdown(sales: DataFrame, orders: DataFrame | None, returns: DataFrame | None) -> DataFrame:
    """Revenue, units, order rows, return rows and refunds of every currency, richest first, in one shuffle."""
    code = currency_code(F.col("currency")).alias("currency")
    parts = [sales.select(code, "revenue", "units")]
    if orders is not None:
        parts.append(orders.select(code, row_weight(orders).alias("order_row")))
    if returns is not None:
        parts.append(returns.select(code, row_weight(returns).alias("return_row"), "refund"))
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)

    def total(c: str, kind: str):
        return (F.coalesce(F.sum(c), F.lit(0)) if c in merged.columns else F.lit(0)).cast(kind)

    return (
        merged.filter(F.col("currency").isNotNull()).groupBy("currency")
        .agg(total("revenue", "double").alias("revenue"), total("units", "double").alias("units"),
             total("order_row", "bigint").alias("orders"), total("return_row", "bigint").alias("returns"),
             total("refund", "double").alias("refund"))
        .orderBy(F.col("revenue").desc(), "currency")
    )


def dimension_by_currency(sales: DataFrame, dim: str) -> DataFrame:
    """Revenue per currency and dimension value; ``group_total`` orders the currencies.

    The totals are a second, tiny aggregation joined back on currency and a salt, so no task ever holds all values of one
    currency, however the join is carried out.
    """
    code = F.coalesce(currency_code(F.col("currency")), F.lit(NO_CURRENCY)).alias("currency")
    cells = (
        sales.filter(real_dimension(F.col(dim)))
        .groupBy(code, F.col(dim).alias("dimension_value")).agg(F.sum("revenue").alias("_current"))
    )
    totals = cells.groupBy("currency").agg(F.sum("_current").cast("double").alias("group_total"))
    salted_cells = cells.withColumn("_salt", F.pmod(F.xxhash64("dimension_value"), F.lit(SALTS)))
    salted_totals = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    return (
        salted_cells.join(salted_totals, ["currency", "_salt"])
        .select("currency", "dimension_value", F.col("_current").cast("double").alias("current"), "group_total")
        .orderBy(F.col("group_total").desc(), "currency", F.col("current").desc(), "dimension_value")
    )
