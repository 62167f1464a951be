"""Writing report tables: one folder per section, by executors, in a columnar or text format."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MANIFEST = "manifest"
WRITERS = ("parquet", "orc", "json", "csv")


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt not in WRITERS:
        raise ValueError(f"Unsupported file type: .{fmt}")
    if fmt == "csv":
        # cells keep their blanks, and quotes are doubled, so that reading the feed back gives the same text
        nested = [f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")]
        flat = df.withColumns({c: F.to_json(c) for c in nested}) if nested else df
        flat.write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        return
    df.write.format(fmt).save(path)


def bundle_path(root: str, period_label: str) -> str:
    """Folder of a report: its period label in lower case with dashes for blanks."""
    return f"{root.rstrip('/')}/business-report-{'-'.join(period_label.split()).lower()}"


def _written(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """A section as it lies on disk. CSV holds nested cells as JSON, so they come back as text."""
    if fmt != "csv":
        return spark.read.schema(schema).format(fmt).load(path)
    flat = T.StructType([T.StructField(f.name, T.StringType() if f.dataType.typeName() in ("array", "struct", "map") else f.dataType)
                         for f in schema.fields])
    return spark.read.schema(flat).csv(path, header=True, escape='"', multiLine=True, ignoreLeadingWhiteSpace=False,
                                       ignoreTrailingWhiteSpace=False)


def _tally(df: DataFrame) -> DataFrame:
    """Rows of a table and a digest of their cells that does not depend on their order."""
    cells = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.xxhash64(cells).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("digest"))


def write_bundle(tables: dict[str, DataFrame], path: str, fmt: str = "parquet") -> dict[str, str]:
    """Every table under its own name, and then the manifest that lists them: section, path, format, rows, schema, digest.

    A feed (``dataset_*``) without a row is left out of the manifest and the answer; an empty section is listed with its
    schema. Each table runs once: rows and digests are read from what was written. Without its manifest, which comes last, a
    bundle does not count.
    """
    if not tables:
        raise ValueError("a bundle needs a table")
    spark, lines, written = next(iter(tables.values())).sparkSession, None, {}
    for name, df in tables.items():
        written[name] = f"{path.rstrip('/')}/{name}"
        write_table(df, written[name], fmt)
        line = _tally(_written(spark, written[name], fmt, df.schema)).select(
            F.lit(len(written)).alias("place"), F.lit(name).alias("section"), F.lit(written[name]).alias("path"), F.lit(fmt).alias("format"),
            "n_rows", F.lit(df.schema.json()).alias("schema"), "digest")
        lines = line if lines is None else lines.unionByName(line)
    lines = lines.where(~F.col("section").startswith("dataset_") | (F.col("n_rows") > 0))
    lines.coalesce(1).write.json(f"{path.rstrip('/')}/{MANIFEST}")  # one line a section
    listed = {r["section"] for r in read_manifest(spark, path)}
    return {name: p for name, p in written.items() if name in listed}


def read_manifest(spark: SparkSession, path: str) -> list[Row]:
    """The sections of a bundle in the order they were written; a bundle without a finished manifest is refused."""
    folder = f"{path.rstrip('/')}/{MANIFEST}"
    schema = "place int, section string, path string, format string, n_rows bigint, schema string, digest string"
    try:
        spark.read.text(f"{folder}/_SUCCESS")  # left by the commit of the manifest itself
        return spark.read.schema(schema).json(folder).orderBy("place").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        raise ValueError(f"{path} holds no finished bundle") from None


def read_bundle(spark: SparkSession, path: str, check: bool = True) -> dict[str, DataFrame]:
    """The listed sections of a bundle. With ``check`` their rows and digests must be those of the manifest."""
    out = {}
    for line in read_manifest(spark, path):
        df = _written(spark, line["path"], line["format"], T.StructType.fromJson(json.loads(line["schema"])))
        if check and tuple(_tally(df).first()) != (line["n_rows"], line["digest"]):
            raise ValueError(f"section {line['section']} of {path} is not what its manifest lists")
        out[line["section"]] = df
    return out
