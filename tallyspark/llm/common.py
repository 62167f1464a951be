"""Helpers shared by the training-data operators: column picking, shared tables, partition counts, connected components."""

from __future__ import annotations

import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pick(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact spelling, whatever else the table carries (also names that differ only in case)."""
    at = {c: i for i, c in reversed(list(enumerate(df.columns)))}
    missing = [n for n in names if n not in at]
    if missing:
        raise ValueError(f"columns {missing} are missing; the table has {df.columns}")
    if len({c.lower() for c in df.columns}) == len(df.columns):
        return df.select(*(F.col(f"`{n}`") for n in names))
    plain = df.toDF(*(f"c{i}" for i in range(len(df.columns))))
    return plain.select(*(F.col(f"c{at[n]}").alias(n) for n in names))


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """``df`` with its columns called _0, _1, ... and the new name of each (the first of equal ones), to work on any table."""
    names = {c: f"_{i}" for i, c in reversed(list(enumerate(df.columns)))}
    return df.toDF(*(f"_{i}" for i in range(len(df.columns)))), names


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers, once per application (as ``--py-files`` would)."""
    context = spark.sparkContext
    if getattr(context, "_tallyspark_shipped", False):
        return
    root = pathlib.Path(__file__).resolve().parents[1]
    path = pathlib.Path(tempfile.mkdtemp(prefix="package-")) / f"{root.name}_package.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent).as_posix())
    context.addPyFile(str(path))
    context._tallyspark_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``; a temporary one on a single machine only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage, survives lost executors, fixes the rows."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: (node, component) with the smallest node of each component.

    Alternating large-star and small-star steps; each step is two shuffles of id pairs, so a hub is never gathered in one
    task. Every round is a table in the shared folder. Self loops and repeated edges are allowed.
    """
    star = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    star = stage(star, "links")
    seen = None
    for _ in range(max_rounds):
        both = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        star = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = star.unionByName(low.where("m < a").select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        moved = star.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        star = stage(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = star.agg(F.count(F.lit(1)), F.sum(F.col("a").cast("decimal(38,0)")), F.sum(F.col("b").cast("decimal(38,0)")),
                       F.bit_xor(F.xxhash64("a", "b"))).first()
        if now == seen or now[0] == 0:
            return star.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                star.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = now
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
