"""Plans that must not change for the worse as the tables grow."""

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tallyspark.functions import coerce
from tallyspark.operators import cleaning
from tallyspark.plans import rawfeeds
from tallyspark.sources import star, synthetic
from tallyspark.spark_tools import SMALL_ROWS


def catalogue(spark, n):
    products = spark.range(n).select(
        F.col("id").alias("pick"), F.col("id").cast("string").alias("sku"), F.lit("thing").alias("name"),
        F.lit(9.5).alias("price"), F.lit(5.5).alias("cost"))
    return products, spark.createDataFrame([("North", 1.0)], "region string, weight double")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_many_products_are_not_gathered_on_the_driver(spark):
    first = dt.date(2025, 4, 1)
    few, many = (synthetic.sales_lines(*catalogue(spark, n), first, first) for n in (9, SMALL_ROWS + 1))
    assert "BroadcastHashJoin" in plan(few) and "Broadcast" not in plan(many)
    assert few.count() == many.count()


def test_lines_of_one_day_are_made_by_several_tasks(spark):
    products, regions = catalogue(spark, 9)
    first = dt.date(2025, 4, 1)
    lines = synthetic.sales_lines(products, regions, first, first, base=5_000.0)
    assert lines.rdd.glom().map(bool).sum() > 1
    assert sorted(r["t"] for r in lines.collect()) == list(range(1, 5_001))


def test_small_files_that_grow_in_a_query_are_dealt_out_first(spark, tmp_path):
    spark.range(500).selectExpr("id as c_custkey", "'a' as c_name", "1 as c_nationkey", "0d as c_acctbal", "'b' as c_mktsegment").coalesce(
        1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.range(500).selectExpr("id as l_orderkey", "id as l_partkey", "id as l_suppkey").coalesce(1).write.parquet(
        str(tmp_path / "lineitem.parquet"))
    headers = rawfeeds.header_catalogue(spark, str(tmp_path))
    stock = star.inventory(spark, str(tmp_path), ["sku", "warehouse"])
    for df in (headers, stock):
        sizes = df.rdd.glom().map(len).collect()
        assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)


def test_cells_are_parsed_apart_and_as_before(spark):
    days = {"2025-01-02": (2025, 1, 2), "Thu, 02 Jan 2025 23:30:00 EST": (2025, 1, 3), "Jan 2, 2025": (2025, 1, 2), "2-Jan-25": (2025, 1, 2),
            "Thu 2 January 2025": (2025, 1, 2), "Jan 2025": (2025, 1, 1), "1.2.2025": (2025, 1, 2), "2025-02-30": None, "[x]": None, "": None}
    numbers = {"12": 12.0, "12\n": 12.0, " $1,200.5 ": 1200.5, "$": 0.0, "1e2": 100.0, ".5": 0.5, "1d": None, "12 3": None, "é1": None}
    texts = {" a": "a", "a　": "a", "a b": "a b", "é ": "é", "": "", "﻿~": "~"}
    for expected, parse, kind in ((days, coerce.parse_day, lambda d: dt.date(*d) if d else d),
                                  (numbers, coerce.parse_number, lambda n: n), (texts, coerce.trim_blanks, lambda s: s)):
        df = spark.createDataFrame([(t,) for t in expected], "t string").repartition(2)
        for value in (parse(F.col("t")), coerce.named(F.col("t"), parse)):
            assert {r["t"]: r["v"] for r in df.select("t", value.alias("v")).collect()} == {t: kind(v) for t, v in expected.items()}
    raw = spark.createDataFrame([("1", "2", 0)], "Date string, Qty string, _ord bigint")
    rows = cleaning.coerce(raw, "sales", {"date": "Date", "units": "Qty"})
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("transform(array(") >= 2


def test_cells_are_parsed_outside_the_generator(spark):
    mapping = {"date": "D", "sku": "S", "units": "U", "revenue": "R"}
    rows = [("Jan 5, 2025", "a", "1", "$1,000.5", 1), ("2025-02-30", "b", "x", "2", 2), ("1/6/25", " c ", "3", "", 3)]
    coerced = cleaning.coerce(spark.createDataFrame(rows, "D string, S string, U string, R string, _ord int"), "sales", mapping)
    generators = [line for line in plan(coerced).splitlines() if "Generate inline" in line]
    assert generators and not any("lambda" in line.lower() or "RLIKE" in line for line in generators)
    got = {r["sku"]: (str(r["date"]), r["units"], r["revenue"], r["_drop"]) for r in coerced.collect()}
    assert got["a"] == ("2025-01-05", 1.0, Decimal("1000.5"), False)
    assert got["b"][::3] == ("None", True) and got["c"][0] == "2025-01-06" and got["c"][3]


def test_parts_are_counted_without_the_orders(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(star, "will_broadcast", lambda df: False)
    monkeypatch.setattr(star, "hot_keys", lambda rows, on: asked.append((on, plan(rows))) or [])
    star.sales(spark, "/root/testdata/sf0.001")
    assert [on for on, _ in asked] == [["o_custkey"], ["l_partkey"]]
    assert not any("Join" in p for _, p in asked)
