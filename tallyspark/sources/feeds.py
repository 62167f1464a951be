"""Reading raw feeds as text tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .csvsplit import read_csv
from .schema import ORD

READERS = ("csv", "json", "parquet", "orc")


def feed_format(path: str) -> str:
    """Format by lower-cased suffix. Workbooks have no distributed reader and are refused like any other suffix."""
    suffix = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[-1].lower()
    if suffix not in READERS:
        raise ValueError(f"Unsupported file type: .{suffix}")
    return suffix


def read_feed(spark: SparkSession, path: str, fmt: str | None = None, multiline: bool = True) -> DataFrame:
    """A feed with every cell as text (blank for missing), trimmed header names and the row ordinal ``_ord``.

    ``_ord`` grows with the position in the file. Of a CSV feed it is the number of the record, counted over the files in the
    order of their paths, and does not depend on the splits. Other formats count by consecutive partitions: the same for the
    same files and split settings; store it with the cleaned table to fix it for good. Quoted cells of a CSV feed keep their
    line breaks in splits of any size; ``multiline=False`` saves the scan that this takes, for feeds known to have none. A
    folder of CSV files must have one header row spelling; a file that differs fails instead of being read by position.
    """
    fmt = fmt or feed_format(path)
    if fmt == "csv" and multiline:
        return read_csv(spark, path)
    if fmt == "csv":
        raw = spark.read.csv(path, header=True, escape='"', enforceSchema=False, ignoreLeadingWhiteSpace=False,
                             ignoreTrailingWhiteSpace=False)
    elif fmt == "json":
        raw = spark.read.json(path, primitivesAsString=True)
    elif fmt in READERS:
        raw = spark.read.format(fmt).load(path)
    else:
        raise ValueError(f"Unsupported file type: .{fmt}")
    cells = [F.coalesce(F.col("`" + c.replace("`", "``") + "`").cast("string"), F.lit("")) for c in raw.columns]
    names = [c.strip().strip("\ufeff") for c in raw.columns]
    return raw.select(*[cell.alias(name) for cell, name in zip(cells, names)], F.monotonically_increasing_id().alias(ORD))


def header_catalogue(feeds: dict[str, tuple[str, DataFrame]]) -> DataFrame:
    """``(feed, dataset, header_ord, header)`` of opened feeds, given as name to (dataset, table)."""
    spark = next(iter(feeds.values()))[1].sparkSession
    rows = [(name, dataset, i, h) for name, (dataset, df) in feeds.items()
            for i, h in enumerate(c for c in df.columns if c != ORD)]
    return spark.createDataFrame(rows, "feed string, dataset string, header_ord int, header string")


