"""De-duplication, coercion and null handling of a raw text feed, with a count for every fix."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import parse_day, parse_money, parse_number, trim_blanks
from ..sources.schema import FIELDS, ORD, UNKNOWN, Field
from ..spark_tools import scratch_path
from .mapping import map_headers

COUNTS = ("total_raw_rows", "duplicates_removed", "nulls_handled", "rows_dropped", "type_mismatches", "clean_rows")
Mapping = dict[str, str | None]


@dataclass(frozen=True)
class Cleaned:
    rows: DataFrame
    counts: DataFrame
    mapping: Mapping


def _cell(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def raw_columns(raw: DataFrame) -> list[str]:
    return [c for c in raw.columns if c not in (ORD, "_copies")]


def dedupe(raw: DataFrame) -> DataFrame:
    """Exact copies of a raw row collapse to the first one; ``_copies`` says how many there were.

    The key is the untrimmed text of all columns. Copies are combined inside each map task, so a row repeated through a
    third of the feed is one row per task in the shuffle.
    """
    cells = raw_columns(raw)
    text = raw.select(*[F.coalesce(_cell(c), F.lit("")).alias(c) for c in cells], ORD)
    return text.groupBy(*[_cell(c) for c in cells]).agg(F.min(ORD).alias(ORD), F.count(F.lit(1)).alias("_copies"))


def duplicates_removed(raw: DataFrame) -> DataFrame:
    return dedupe(raw).agg(F.coalesce(F.sum("_copies"), F.lit(0)).alias("total_raw_rows"),
                           F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicates_removed"))


def _parsed(field: Field, text: Column) -> Column:
    if field.kind == "number":
        return parse_number(text)
    if field.kind == "money":
        return parse_money(text)
    if field.kind == "date":
        return parse_day(text)
    return text


def _default(field: Field) -> Column:
    value = {"string": UNKNOWN, "number": 0.0, "money": 0, "date": None}[field.kind]
    return F.lit(value).cast(field.spark_type)


def coerce(deduped: DataFrame, dataset: str, mapping: Mapping) -> DataFrame:
    """Canonical columns of every row plus ``_drop``, ``_nulls`` and ``_mismatches``; nothing is filtered yet.

    Counts cover rows that are dropped as well, and a bad required cell is a drop, not a mismatch.
    """
    fields = FIELDS[dataset]
    copies = F.col("_copies") if "_copies" in deduped.columns else F.lit(1).cast("bigint").alias("_copies")
    texts = [(trim_blanks(_cell(mapping[f.key])) if mapping.get(f.key) else F.lit("")).alias(f"t_{f.key}") for f in fields]
    cells = deduped.select(ORD, copies, *texts)
    # the cells are parsed in a projection of their own, which Spark generates as many short methods: within a generator they
    # would be interpreted, and as one method they would be too long to be compiled to machine code. The parsed cells then
    # pass through a generator: filters on them stay above it, so no cell is parsed a second time (the optimizer would
    # otherwise copy the parsing into a filter below the de-duplication)
    cells = cells.select(ORD, "_copies", *[
        c for f in fields for c in ((F.coalesce(F.col(f"t_{f.key}"), F.lit("")) == "").alias(f"b_{f.key}"),
                                    _parsed(f, F.col(f"t_{f.key}")).alias(f"p_{f.key}"))])
    cells = cells.select(ORD, "_copies", F.inline(F.array(F.struct(*[f"{x}_{f.key}" for f in fields for x in "bp"]))))

    def blank(f: Field) -> Column:
        return F.col(f"b_{f.key}")

    def bad(f: Field) -> Column:
        return ~blank(f) & F.col(f"p_{f.key}").isNull()

    none = F.lit(0)
    drop = F.lit(False)
    nulls, mismatches = none, none
    for f in fields:
        if f.required:
            drop = drop | blank(f) | bad(f)
        else:
            nulls = nulls + blank(f).cast("int")
            mismatches = mismatches + bad(f).cast("int")
    values = [F.when(blank(f) | F.col(f"p_{f.key}").isNull(), _default(f)).otherwise(F.col(f"p_{f.key}")).alias(f.key)
              for f in fields]
    return cells.select(*values, ORD, "_copies", drop.alias("_drop"), nulls.alias("_nulls"),
                        mismatches.alias("_mismatches"))


def kept_rows(coerced: DataFrame, dataset: str) -> DataFrame:
    return coerced.filter(~F.col("_drop")).select(*[f.key for f in FIELDS[dataset]], ORD)


def cleaning_counts(coerced: DataFrame, dataset: str) -> DataFrame:
    """All six counters in one pass over the coerced rows."""
    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).cast("bigint")

    return coerced.agg(
        total(F.col("_copies")).alias("total_raw_rows"), total(F.col("_copies") - 1).alias("duplicates_removed"),
        total(F.col("_nulls")).alias("nulls_handled"), F.count_if(F.col("_drop")).alias("rows_dropped"),
        total(F.col("_mismatches")).alias("type_mismatches"), F.count_if(~F.col("_drop")).alias("clean_rows"),
    ).select(F.lit(dataset).alias("dataset"), *COUNTS)


def clean(raw: DataFrame, dataset: str, overrides: Mapping | None = None, mapping: Mapping | None = None,
          stage: bool = False) -> Cleaned:
    """Map headers, drop copies, coerce, count.

    Rows and counts both come from the de-duplicated feed. With ``stage`` that one is written once to the shared scratch
    folder and read back, so a large feed is shuffled a single time and ``_ord`` is fixed from then on.
    """
    spark = raw.sparkSession
    if mapping is None:
        mapping = map_headers(spark, dataset, raw_columns(raw), overrides)
    coerced = coerce(dedupe(raw), dataset, mapping)
    if stage:
        path = scratch_path(spark, f"clean-{dataset}")
        coerced.write.parquet(path)
        coerced = spark.read.parquet(path)
    return Cleaned(kept_rows(coerced, dataset), cleaning_counts(coerced, dataset), mapping)


def cleaning_totals(*counts: DataFrame) -> DataFrame:
    """The counters of every dataset and, with dataset ``all``, their sums."""
    merged = counts[0]
    for c in counts[1:]:
        merged = merged.unionByName(c)
    return merged.rollup("dataset").agg(*[F.sum(c).alias(c) for c in COUNTS]).withColumn(
        "dataset", F.coalesce("dataset", F.lit("all")))


def required_blank_warning(deduped: DataFrame, dataset: str, mapping: Mapping, sample: int | None = None) -> DataFrame:
    """Blank cells of each mapped required column in all rows, or within the first ``sample`` ones where that is asked for."""
    needed = [f for f in FIELDS[dataset] if f.required and mapping.get(f.key)]
    cells = deduped.select(ORD, *[trim_blanks(_cell(mapping[f.key])).alias(f.key) for f in needed])
    if sample is not None:
        cells = cells.orderBy(ORD).limit(sample)
    counted = cells.agg(F.count(F.lit(1)).alias("sampled"), *[
        F.count_if(F.coalesce(F.col(f.key), F.lit("")) == "").alias(f.key) for f in needed])
    rows = counted.select("sampled", F.inline(F.array(*[
        F.struct(F.lit(i).alias("ord"), F.lit(f.key).alias("field"), F.lit(mapping[f.key]).alias("header"),
                 F.col(f.key).alias("blank")) for i, f in enumerate(needed)])))
    everything = F.format_string("Blank in all %d sampled rows — matching rows will be dropped.", "sampled")
    some = F.format_string("Blank in %d of %d sampled rows — those rows will be dropped.", "blank", "sampled")
    return rows.filter((F.col("sampled") > 0) & (F.col("blank") > 0)).withColumn(
        "warning", F.when(F.col("blank") == F.col("sampled"), everything).otherwise(some)).drop("ord")
