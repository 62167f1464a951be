"""Canonical datasets projected out of a retail star schema (lineitem, orders, customer, nation, region, part).

Each adapter takes the columns the caller needs and joins only the tables that supply them, so a per-SKU weekly series
reads three lineitem columns and joins nothing. Every lineitem has its order and part and every order its customer, so a
skipped join never changes the rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import hot_keys, skew_join
from ..spark_tools import estimated_bytes, spread, will_broadcast
from .schema import FIELDS, ORD

# The three reporting currencies, dealt out by nation.
CURRENCIES = ("USD", "EUR", "INR")
# Bytes of the lineitem table whose pairs of part and supplier make up one task of the stock list.
PAIR_BYTES = 8 << 20

SALES_COLUMNS, ORDERS_COLUMNS, RETURNS_COLUMNS, INVENTORY_COLUMNS = (
    tuple(f.key for f in FIELDS[name]) for name in ("sales", "orders", "returns", "inventory"))

# Declared schemas spare a footer-reading job per table.
SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _currency() -> Column:
    key = F.col("c_nationkey") % 3
    return F.when(key == 0, CURRENCIES[0]).when(key == 1, CURRENCIES[1]).otherwise(CURRENCIES[2])


def _lookup(rows: DataFrame, table_: DataFrame, key: str, table_key: str, keys: DataFrame | None = None) -> DataFrame:
    """``rows`` with the columns of a table of unique keys; hot keys are split where the table is too large to broadcast.

    They are looked for in ``keys`` where that is given: rows before their joins, which are then not run for it.
    """
    own = table_.withColumnRenamed(table_key, key)
    if will_broadcast(own):
        return rows.join(own, key)
    hot = hot_keys(rows if keys is None else keys, [key])
    return skew_join(rows, own, [key], hot=hot, spread=F.struct(*[c for c in ("o_orderkey", "l_orderkey", "l_linenumber") if c in rows.columns]))


def _customers(spark: SparkSession, sf_dir: str, region: bool) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    if not region:
        return customers
    nations = (
        table(spark, sf_dir, "nation")
        .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select("n_nationkey", "r_name")
    )
    return customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).drop("n_nationkey")


def _order_side(spark: SparkSession, sf_dir: str, wanted: set[str], keep: list[str]) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    if wanted & {"region", "currency"}:
        people = _customers(spark, sf_dir, "region" in wanted)
        orders = _lookup(orders, people, "o_custkey", "c_custkey")
        keep = [*keep, "c_nationkey", *(["r_name"] if "region" in wanted else [])]
    return orders.select(*keep)


def _line_columns() -> dict[str, Column]:
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return {
        "date": F.col("l_shipdate").cast("date"),
        "sku": F.col("l_partkey").cast("string"),
        "product": F.col("p_name"),
        "region": F.col("r_name"),
        "channel": F.col("o_orderpriority"),
        "units": F.col("l_quantity"),
        "unitPrice": price,
        "revenue": (price * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)"),
        "currency": _currency(),
        ORD: F.col("l_orderkey") * 8 + F.col("l_linenumber"),
    }


def _lines(spark: SparkSession, sf_dir: str, wanted: set[str], returned_only: bool = False) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    if returned_only:
        lines = lines.filter(F.col("l_returnflag") == "R")
    scanned = lines
    if wanted & {"region", "currency", "channel"}:
        head = _order_side(spark, sf_dir, wanted, ["o_orderkey", "o_orderpriority"])
        lines = lines.join(head, F.col("l_orderkey") == F.col("o_orderkey"))
    if "product" in wanted:
        parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
        lines = _lookup(lines, parts, "l_partkey", "p_partkey", scanned)
    return lines


def sales(spark: SparkSession, sf_dir: str, columns: Iterable[str] = SALES_COLUMNS, order: bool = False) -> DataFrame:
    columns = list(columns)
    source = _line_columns()
    lines = _lines(spark, sf_dir, set(columns))
    return lines.select(*[source[c].alias(c) for c in columns + ([ORD] if order else [])])


def returns(spark: SparkSession, sf_dir: str, columns: Iterable[str] = RETURNS_COLUMNS, order: bool = False) -> DataFrame:
    columns = list(columns)
    line = _line_columns()
    source = {
        "returnId": F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")),
        "orderId": F.col("l_orderkey").cast("string"),
        "sku": line["sku"],
        "returnDate": line["date"],
        "reason": F.col("l_returnflag"),
        "units": line["units"],
        "refund": line["revenue"],
        "currency": line["currency"],
        ORD: line[ORD],
    }
    lines = _lines(spark, sf_dir, set(columns), returned_only=True)
    return lines.select(*[source[c].alias(c) for c in columns + ([ORD] if order else [])])


def orders(spark: SparkSession, sf_dir: str, columns: Iterable[str] = ORDERS_COLUMNS, order: bool = False) -> DataFrame:
    columns = list(columns)
    source = {
        "orderId": F.col("o_orderkey").cast("string"),
        "orderDate": F.col("o_orderdate").cast("date"),
        "customerId": F.col("o_custkey").cast("string"),
        "channel": F.col("o_orderpriority"),
        "region": F.col("r_name"),
        "status": F.col("o_orderstatus"),
        "total": F.col("o_totalprice").cast("decimal(18,2)"),
        "currency": _currency(),
        ORD: F.col("o_orderkey"),
    }
    keep = ["o_orderkey", "o_orderdate", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice"]
    heads = _order_side(spark, sf_dir, set(columns), keep)
    return heads.select(*[source[c].alias(c) for c in columns + ([ORD] if order else [])])


def inventory(spark: SparkSession, sf_dir: str, columns: Iterable[str] = INVENTORY_COLUMNS,
              order: bool = False) -> DataFrame:
    """One row per part and supplier that occur together in a lineitem."""
    columns = list(columns)
    lines = table(spark, sf_dir, "lineitem")
    # pairs of keys take little room until they are written out as text: dealt out by their number, not by their bytes
    stock = spread(lines.select("l_partkey", "l_suppkey").distinct(), estimated_bytes(lines), PAIR_BYTES)
    if set(columns) & {"productName", "reorderPoint", "unitCost"}:
        parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_retailprice")
        stock = stock.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    source = {
        "sku": F.col("l_partkey").cast("string"),
        "productName": F.col("p_name"),
        "warehouse": F.concat(F.lit("DC-"), F.col("l_suppkey").cast("string")),
        "onHand": ((F.col("l_partkey") * 7 + F.col("l_suppkey") * 13) % 200).cast("double"),
        "reorderPoint": F.col("p_size").cast("double"),
        "unitCost": (F.col("p_retailprice").cast("decimal(18,2)") * F.lit("0.6").cast("decimal(2,1)")).cast("decimal(18,3)"),
        ORD: F.col("l_partkey") * 1_000_000 + F.col("l_suppkey"),
    }
    return stock.select(*[source[c].alias(c) for c in columns + ([ORD] if order else [])])


def unit_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit cost per SKU. It is the same in every warehouse, so first-in-file order plays no part here, and costs of parts
    never stocked match no sale."""
    cost = (F.col("p_retailprice").cast("decimal(18,2)") * F.lit("0.6").cast("decimal(2,1)")).cast("decimal(18,3)")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("sku"), cost.alias("unitCost"))
