"""Daily folds: the only readers of raw rows, written once and re-aggregated by every table of a report.

A fold has one row per day and dimension values, with the sums of the feed's measures, the first file position and ``_rows``,
the number of raw rows behind it. It has the columns of its feed, so every operator that sums and counts takes it in the
feed's place. Currency codes are folded as they compare, in upper case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.schema import DATE_COLUMN, ORD
from ..spark_tools import scratch_path
from .scoping import ROWS, count_rows, currency_code

DIMENSIONS = {"sales": ("sku", "region", "channel", "currency"), "orders": ("channel", "currency"), "returns": ("sku", "currency")}
MEASURES = {"sales": ("revenue", "units"), "orders": (), "returns": ("units", "refund")}
ALL_CHANNELS = "*"


def daily_fold(feed: DataFrame, dataset: str, dimensions: Iterable[str] | None = None) -> DataFrame:
    """``feed`` folded to its days and ``dimensions`` (all that it has by default). Folding a fold again is allowed."""
    wanted = DIMENSIONS[dataset] if dimensions is None else tuple(dimensions)
    keys = [DATE_COLUMN[dataset], *(d for d in wanted if d in feed.columns)]
    if "currency" in keys:
        feed = feed.withColumn("currency", currency_code(F.col("currency")))
    sums = [F.sum(m).alias(m) for m in MEASURES[dataset] if m in feed.columns]
    first = [F.min(ORD).alias(ORD)] if ORD in feed.columns else []
    return feed.groupBy(*keys).agg(*sums, *first, count_rows(feed).alias(ROWS))


def all_scopes(fold: DataFrame, dataset: str) -> DataFrame:
    """A fold for every currency and for every channel of it; the channel of a whole currency is ``*``.

    The rows of a fold are those of its channels already and go on as they are; only the whole currencies are added up. Amounts
    of different currencies are never added up, so there is no set without the currency.
    """
    dims = [c for c in (DATE_COLUMN[dataset], *DIMENSIONS[dataset]) if c in fold.columns]
    measures = [c for c in (*MEASURES[dataset], ROWS) if c in fold.columns]
    whole = fold.groupBy(*[c for c in dims if c != "channel"]).agg(*[F.sum(c).alias(c) for c in measures])
    whole = whole.withColumn("channel", F.lit(ALL_CHANNELS))
    if "channel" not in dims:
        return whole
    own = fold.select(*dims, *[F.col(c).cast(whole.schema[c].dataType).alias(c) for c in measures])
    return own.unionByName(whole)


def staged_folds(feeds: dict[str, DataFrame | None], fold_of: Callable[[DataFrame, str], DataFrame] = daily_fold,
                 ) -> dict[str, DataFrame | None]:
    """The folds of sales, orders and returns, written to the shared scratch folder and read back: each feed is scanned this
    once, all of them at the same time. Other feeds and absent ones stay as they are."""
    def write(dataset: str) -> DataFrame:
        fold = fold_of(feeds[dataset], dataset)
        path = scratch_path(fold.sparkSession, f"fold-{dataset}")
        fold.write.parquet(path)
        return fold.sparkSession.read.schema(fold.schema).parquet(path)

    wanted = [n for n, df in feeds.items() if df is not None and n in DIMENSIONS]
    if not wanted:
        return dict(feeds)
    spark = feeds[wanted[0]].sparkSession
    scratch_path(spark, "fold")  # settles the folder before the threads ask for it
    with ThreadPoolExecutor(len(wanted)) as pool:
        return dict(feeds) | dict(zip(wanted, pool.map(inheritable_thread_target(spark)(write), wanted)))
