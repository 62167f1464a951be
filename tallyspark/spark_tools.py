"""Small helpers shared by the operators: sessions for local runs, size-checked broadcasts, shared scratch space."""

from __future__ import annotations

import os
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 10_000


def local_session(cpus: str = "*", app: str = "tallyspark") -> SparkSession:
    """Session for tests and benchmarks on one machine. A cluster brings its own session and settings."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def small_rows(df: DataFrame, max_rows: int = SMALL_ROWS) -> pa.Table | None:
    """All rows of ``df`` when there are at most ``max_rows``, else None. At most ``max_rows + 1`` reach the driver."""
    rows = df.limit(max_rows + 1).toArrow()
    return rows if rows.num_rows <= max_rows else None


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` as a broadcast table when it is proven small, else ``df`` as it is, to be joined by shuffle."""
    rows = small_rows(df, max_rows)
    return df if rows is None else F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer takes the size of ``df`` for, from file sizes; runs no job."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame, size: int, share: int) -> DataFrame:
    """``df`` dealt out evenly, over a shuffle partition for every ``share`` of ``size`` bytes where that is more than there are."""
    return df.repartition(max(shuffle_parts(df.sparkSession), -(-size // share)))


def will_broadcast(df: DataFrame) -> bool:
    """Whether the optimizer takes ``df`` for small enough to broadcast it by itself."""
    bound = df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()
    return estimated_bytes(df) <= int(bound)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder below the shared checkpoint folder. On a cluster that one must be configured; a single machine, as in
    tests, gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tallyspark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
