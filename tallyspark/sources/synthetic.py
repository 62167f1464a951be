"""Synthetic sales, orders, inventory and returns feeds with planted anomalies and injected dirt.

Every draw is a hash of the row's own identity and a seed, so the feeds come out the same on any cluster and any task can
be run again. Demand follows season, weekday, slow growth and a weight per region; the plants are known truths that the
detectors must find.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..spark_tools import SMALL_ROWS, shuffle_parts

# Demand multipliers per month of the year (others 1), weekend lift, growth per month, channel weights,
# return reasons, rates of duplicated rows and blanked cells per feed.
SEASON = {1: 0.8, 7: 1.2, 8: 1.2, 11: 1.45, 12: 1.45}
WEEKEND, GROWTH = 1.25, 0.012
LINE_BLOCK, TASK_LINES = 1_000, 500_000  # lines of a day that stay together, lines that a task makes
CHANNELS = {"Online": 1.2, "Retail": 0.9, "Wholesale": 0.6}
REASONS = ("Defective", "Wrong item", "No longer needed", "Sizing issue", "Damaged in transit")
WAREHOUSES = ("Harbour", "Airport", "Depot", "Annex")
DIRT = {
    "sales": (0.015, {"Region": 0.02, "Channel": 0.015, "Revenue": 0.01}),
    "orders": (0.02, {"Region": 0.02, "CustomerID": 0.015}),
    "inventory": (0.0, {"Reorder Pt": 0.03}),
    "returns": (0.02, {"Reason": 0.03}),
}
RAW_HEADERS = {
    "sales": {"date": "Date", "sku": "SKU", "product": "Product", "region": "Region", "channel": "Channel",
              "units": "Qty", "unitPrice": "Unit Price", "revenue": "Revenue"},
    "orders": {"orderId": "OrderID", "orderDate": "Order Date", "customerId": "CustomerID", "channel": "Channel",
               "region": "Region", "status": "Status", "total": "Total"},
    "inventory": {"sku": "SKU", "productName": "Product Name", "warehouse": "Warehouse", "onHand": "On Hand",
                  "reorderPoint": "Reorder Pt", "unitCost": "Unit Cost"},
    "returns": {"returnId": "ReturnID", "orderId": "OrderID", "sku": "SKU", "returnDate": "Return Date",
                "reason": "Reason", "units": "Units", "refund": "Refund"},
}


@dataclass(frozen=True)
class Plants:
    """Known anomalies; leave a field None to plant nothing there. Months are given by their first day."""

    slump: tuple[str, dt.date, float] | None = None  # region, month, factor
    promotion: tuple[str, dt.date, dt.date, int] | None = None  # SKU, first day, last day, factor
    spike: tuple[str, dt.date, int] | None = None  # SKU, day, factor
    defect_wave: tuple[str, dt.date, int] | None = None  # SKU, month, extra returns per return
    stockout: tuple[str, str] | None = None  # SKU, warehouse


def draw(seed: int, salt: str, *identity: Column) -> Column:
    """Uniform number in [0, 1) fixed by seed, purpose and row identity."""
    return F.pmod(F.xxhash64(*identity, F.lit(salt), F.lit(seed)), F.lit(1 << 31)) / float(1 << 31)


def _whole(u: Column, low: int, high: int) -> Column:
    return (F.floor(u * (high - low + 1)) + low).cast("int")


def _pick(u: Column, values: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), _whole(u, 1, len(values)))


def _per_month(d: Column, factors: dict[int, float]) -> Column:
    out = F.lit(1.0)
    for month, factor in factors.items():
        out = F.when(F.month(d) == month, factor).otherwise(out)
    return out


def _joined_product(rows: DataFrame, products: DataFrame, n_products: int, seed: int, salt: str,
                    *identity: Column) -> DataFrame:
    chosen = F.floor(draw(seed, salt, *identity) * n_products).cast("bigint")
    if n_products > SMALL_ROWS:  # the file size says little about what the broadcast would take on the driver
        products = products.hint("merge")
    return rows.withColumn("pick", chosen).join(products, "pick")


def sales_lines(products: DataFrame, regions: DataFrame, start: dt.date, end: dt.date, plants: Plants = Plants(),
                base: float = 4.0, seed: int = 1) -> DataFrame:
    """One row per sold line. ``products (pick 0..n-1, sku, name, price, cost)``; ``regions (region, weight)``."""
    day = F.col("date")
    months = (F.year(day) - start.year) * 12 + F.month(day) - start.month
    lines = regions.select("region", "weight", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
    slump = F.lit(1.0)
    if plants.slump:
        region, month, factor = plants.slump
        slump = F.when((F.col("region") == region) & (F.trunc(day, "MM") == F.lit(month)), factor).otherwise(1.0)
    volume = (base * F.col("weight") * F.when(F.dayofweek(day).isin(1, 7), WEEKEND).otherwise(1.0)
              * _per_month(day, SEASON) * (1 + months * GROWTH) * slump)
    lines = lines.withColumn("n", F.floor(volume + 0.5).cast("int")).filter("n > 0")
    # the calendar is spread over the cluster in blocks of lines, as many as there are lines, before it is blown up
    total = lines.agg(F.sum("n")).first()[0] or 0
    first = F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(LINE_BLOCK))).alias("first")
    blocks = lines.select("region", "date", "n", first).repartition(
        max(shuffle_parts(lines.sparkSession), -(-total // TASK_LINES)), "region", "date", "first")
    lines = blocks.select("region", "date", F.explode(F.sequence(
        F.col("first"), F.least(F.col("n"), F.col("first") + (LINE_BLOCK - 1)))).alias("t"))
    who = [F.col("region"), day, F.col("t")]
    lines = _joined_product(lines, products, products.count(), seed, "product", *who)
    lines = lines.withColumn("channel", _pick(draw(seed, "channel", *who), tuple(CHANNELS)))
    weight = F.lit(1.0)
    for name, w in CHANNELS.items():
        weight = F.when(F.col("channel") == name, w).otherwise(weight)
    units = F.greatest(F.lit(1), F.floor(_whole(draw(seed, "units", *who), 1, 4) * weight + 0.5).cast("int"))
    if plants.promotion:
        sku, first, last, factor = plants.promotion
        hit = (F.col("sku") == sku) & day.between(F.lit(first), F.lit(last))
        units = units * F.when(hit, factor).otherwise(1)
    if plants.spike:
        sku, on, factor = plants.spike
        units = units * F.when((F.col("sku") == sku) & (day == F.lit(on)), factor).otherwise(1)
    lines = lines.withColumn("units", units)
    price = F.col("price").cast("decimal(18,2)")
    return lines.select("date", "sku", F.col("name").alias("product"), "region", "channel",
                        F.col("units").cast("double").alias("units"), price.alias("unitPrice"),
                        (price * F.col("units")).cast("decimal(18,2)").alias("revenue"), "t")


def order_heads(lines: DataFrame, seed: int = 1) -> DataFrame:
    """About one order for every three lines of a region and day."""
    key = ["date", "region", "slot"]
    grouped = lines.withColumn("slot", F.floor((F.col("t") - 1) / 3).cast("int")).groupBy(*key).agg(
        F.sum("revenue").cast("decimal(18,2)").alias("total"), F.min_by("channel", "t").alias("channel"))
    who = [F.col(c) for c in key]
    status = F.when(draw(seed, "status", *who) < 4 / 6, "Fulfilled").when(
        draw(seed, "status", *who) < 5 / 6, "Cancelled").otherwise("Refunded")
    return grouped.select(
        F.concat_ws("-", F.lit("ORD"), F.date_format("date", "yyyyMMdd"), "region", F.col("slot").cast("string")).alias("orderId"),
        F.col("date").alias("orderDate"),
        F.concat(F.lit("CUST-"), _whole(draw(seed, "customer", *who), 1000, 9999).cast("string")).alias("customerId"),
        "channel", "region", status.alias("status"), "total")


def return_lines(orders: DataFrame, products: DataFrame, plants: Plants = Plants(), seed: int = 1) -> DataFrame:
    """Refunded orders and a few of the others come back; a defect wave multiplies one SKU's returns in one month."""
    who = [F.col("orderId")]
    back = orders.filter((F.col("status") == "Refunded") | (draw(seed, "return", *who) <= 0.06))
    back = _joined_product(back.select("orderId", "orderDate"), products, products.count(), seed, "returned", *who)
    wave = F.lit(False)
    extra = 0
    if plants.defect_wave:
        sku, month, extra = plants.defect_wave
        wave = (F.col("sku") == sku) & (F.trunc("orderDate", "MM") == F.lit(month))
    back = back.withColumn("wave", wave)
    copies = F.sequence(F.lit(0), F.when(F.col("wave"), extra).otherwise(0))
    back = back.withColumn("copy", F.explode(copies))
    each = [*who, F.col("copy")]
    return back.select(
        F.concat_ws("-", F.lit("RET"), "orderId", F.col("copy").cast("string")).alias("returnId"), "orderId", "sku",
        F.col("orderDate").alias("returnDate"),
        F.when(F.col("wave"), "Defective").otherwise(_pick(draw(seed, "reason", *each), REASONS)).alias("reason"),
        _whole(draw(seed, "returned units", *each), 1, 2).cast("double").alias("units"),
        _whole(draw(seed, "refund", *each), 20, 200).cast("decimal(18,2)").alias("refund"))


def stock_rows(products: DataFrame, plants: Plants = Plants(), seed: int = 1) -> DataFrame:
    rows = products.withColumn("warehouse", F.explode(F.array(*[F.lit(w) for w in WAREHOUSES])))
    who = [F.col("sku"), F.col("warehouse")]
    on_hand = _whole(draw(seed, "stock", *who), 20, 400)
    if plants.stockout:
        sku, warehouse = plants.stockout
        on_hand = F.when((F.col("sku") == sku) & (F.col("warehouse") == warehouse),
                         _whole(draw(seed, "stockout", *who), 2, 8)).otherwise(on_hand)
    return rows.select(
        "sku", F.col("name").alias("productName"), "warehouse", on_hand.cast("double").alias("onHand"),
        _whole(draw(seed, "reorder", *who), 30, 80).cast("double").alias("reorderPoint"),
        F.col("cost").cast("decimal(18,2)").alias("unitCost"))


def dirty_feed(rows: DataFrame, dataset: str, seed: int = 1, shuffled: bool = False) -> DataFrame:
    """Text under export headers with duplicated rows, then blanks put into single cells of single copies."""
    rate, blanks = DIRT[dataset]
    headers = RAW_HEADERS[dataset]
    who = [F.col(c) for c in rows.columns]
    numbers = {"units", "onHand", "reorderPoint"}
    cells = [(F.col(c).cast("bigint") if c in numbers else F.col(c)).cast("string").alias(h) for c, h in headers.items()]
    copies = F.sequence(F.lit(0), F.when(draw(seed, "duplicate", *who) < rate, 1).otherwise(0))
    raw = rows.withColumn("_copy", F.explode(copies)).select(*cells, F.xxhash64(*who).alias("_id"), "_copy")
    identity = [F.col("_id"), F.col("_copy")]
    raw = raw.withColumns({h: F.when(draw(seed, f"blank {h}", *identity) < r, "").otherwise(F.col(h))
                           for h, r in blanks.items()})
    if shuffled:
        raw = raw.orderBy(draw(seed, "order", *identity))
    return raw.select(*headers.values())
