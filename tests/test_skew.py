"""Joins with hot keys: the same rows as a plain join, in tasks of about one size."""

import contextlib
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import skew
from tallyspark.sources import star
from tallyspark.sources.schema import ORD

SF = "/root/testdata/sf0.001"


@contextlib.contextmanager
def conf(spark, **settings):
    names = {k.replace("_", "."): v for k, v in settings.items()}
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def lines(spark, n=20_000):
    """60 % of the rows on key 7, a tenth without a key, the rest spread."""
    i = F.col("id")
    key = F.when(i % 10 < 6, F.lit(7)).when(i % 10 < 7, F.lit(None)).otherwise(F.pmod(F.xxhash64("id"), F.lit(500)))
    return spark.range(n).select(key.cast("bigint").alias("k"), (i * 3).alias(ORD), (i % 11).alias("v"))


def names(spark):
    """Keys 0 to 399, key 7 twice, and one without a key."""
    own = spark.range(400).select(F.col("id").alias("k"), F.concat(F.lit("n"), "id").alias("name"))
    more = spark.createDataFrame([(7, "again"), (None, "none")], "k bigint, name string")
    return own.unionByName(more)


def test_hot_keys(spark):
    rows = lines(spark)
    want = rows.where("k = 7").select(skew.key_hash(["k"])).first()[0]
    assert skew.hot_keys(rows, ["k"], 0.3) == [want] and skew.hot_keys(rows, ["k"], 0.9) == []
    assert skew.hot_keys(rows.limit(0), ["k"]) == [] and skew.hot_keys(rows.where("k is null"), ["k"]) == []


@pytest.mark.parametrize("how", skew.HOWS)
def test_same_rows_as_a_plain_join(spark, how):
    rows, other = lines(spark, 3000), names(spark)
    got, want = skew.skew_join(rows, other, ["k"], how), rows.join(other, ["k"], how)
    assert got.columns == want.columns
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, want.collect()))


def test_equal_rows_without_a_position(spark):
    rows = spark.createDataFrame([("a", 1)] * 50 + [("b", 2)], "k string, v int")
    other = spark.createDataFrame([("a", "x"), ("a", "y"), ("c", "z")], "k string, name string")
    assert skew.skew_join(rows, other, ["k"]).groupBy("name").count().orderBy("name").collect() == [("x", 50), ("y", 50)]


def test_refused(spark):
    with pytest.raises(ValueError, match="repeated"):
        skew.skew_join(lines(spark), names(spark), ["k"], "full")
    with pytest.raises(ValueError, match="types"):
        skew.skew_join(lines(spark), names(spark).withColumn("k", F.col("k").cast("int")), ["k"])


def test_no_task_gets_much_more_than_the_others(spark):
    with conf(spark, spark_sql_adaptive_enabled="false", spark_sql_autoBroadcastJoinThreshold="-1", spark_sql_shuffle_partitions="8"):
        rows, other = lines(spark, 80_000), names(spark).where("name <> 'again'")

        def sizes(joined):
            return [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]

        plain, split = sizes(rows.join(other, ["k"])), sizes(skew.skew_join(rows, other, ["k"]))
    assert sum(plain) == sum(split) and max(plain) > 5 * statistics.median(plain)
    assert len(split) == 8 and max(split) <= 2 * statistics.median(split)


def test_star_rows_without_broadcasts(spark):
    want = Counter(map(tuple, star.sales(spark, SF).collect()))
    with conf(spark, spark_sql_autoBroadcastJoinThreshold="-1"):
        assert Counter(map(tuple, star.sales(spark, SF).collect())) == want
