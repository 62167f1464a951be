"""Matching the headers of many feeds to canonical fields, all feeds in one job.

Input is a catalogue ``(feed, dataset, header_ord, header)``. Every header is scored against the fixed alias lists of its
dataset; then each feed folds over its fields in schema order, taking the best header still free. A feed has at most nine
fields, so at most eight headers can be taken by others: nine ranked candidates per field always contain the right one,
and that exact bound is all a feed ever gathers, however many columns it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_identifier_header, normalize_header, similarity
from ..sources.schema import FIELDS
from .ranking import top_k

# Match stages in the order they are tried, and the similarity a header needs.
EXACT, CONTAINS, SIMILAR = 1, 2, 3
MIN_SIMILARITY = 0.8
MOST_FIELDS = max(len(fields) for fields in FIELDS.values())


def field_table(spark: SparkSession) -> DataFrame:
    """The canonical fields as a table (31 rows, a constant of the library)."""
    rows = [(d, i, f.key, f.label, f.kind, f.required, list(f.aliases))
            for d, fields in FIELDS.items() for i, f in enumerate(fields)]
    return spark.createDataFrame(
        rows, "dataset string, field_ord int, field string, label string, kind string, required boolean, "
              "aliases array<string>")


def _distinct_headers(headers: DataFrame) -> DataFrame:
    return headers.groupBy("feed", "dataset", "header").agg(F.min("header_ord").alias("header_ord"))


def _length_allows(a: Column, b: Column) -> Column:
    """Texts whose lengths alone differ too much cannot be similar; this spares most edit distances."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.abs(F.length(a) - F.length(b)) <= (1 - MIN_SIMILARITY) * longest + 1e-9


def header_candidates(headers: DataFrame) -> DataFrame:
    """Every field a header could stand for, with the first stage that accepts it and its similarity score."""
    pairs = (
        headers.withColumn("norm", normalize_header(F.col("header")))
        .withColumn("is_identifier", is_identifier_header(F.col("header")))
        .join(F.broadcast(field_table(headers.sparkSession)), "dataset")
    )
    norm = F.col("norm")
    allowed = (F.col("kind") == "string") | ~F.col("is_identifier")
    scored = pairs.withColumn(
        "stage",
        F.when(F.array_contains("aliases", norm), EXACT)
        .when(allowed & F.exists("aliases", lambda a: F.contains(norm, a)), CONTAINS)
        .when(allowed, SIMILAR),
    ).filter(F.col("stage").isNotNull()).withColumn(
        "score",
        F.when(F.col("stage") == SIMILAR, F.array_max(F.transform(
            F.filter("aliases", lambda a: _length_allows(norm, a)), lambda a: similarity(norm, a))))
        .otherwise(1.0),
    )
    return scored.filter(F.col("score") >= MIN_SIMILARITY).select(
        "feed", "dataset", "field_ord", "field", "header_ord", "header", "stage", "score")


def _fold(fields: Column, candidates: Column, pinned: Column) -> Column:
    """Array of ``(field, header, match_type)`` in field order."""
    chosen_type = "array<struct<field_ord:int,field:string,header:string,match_type:string>>"
    start = F.struct(
        F.filter(F.transform(fields, lambda f: F.try_element_at(pinned, f["field"])),
                 lambda h: h.isNotNull() & (h != "")).alias("used"),
        F.array().cast(chosen_type).alias("chosen"))

    def settle(acc: Column, f: Column, pick: Column) -> Column:
        is_pinned = F.coalesce(F.map_contains_key(pinned, f["field"]), F.lit(False))
        pin = F.nullif(F.try_element_at(pinned, f["field"]), F.lit(""))
        header = F.when(is_pinned, pin).otherwise(pick["header"])
        kind = (
            F.when(is_pinned, F.when(pin.isNotNull(), "manual").otherwise("none"))
            .when(pick.isNull(), "none").when(pick["stage"] == EXACT, "exact").otherwise("fuzzy")
        )
        row = F.struct(f["field_ord"].alias("field_ord"), f["field"].alias("field"), header.alias("header"),
                       kind.alias("match_type"))
        return F.struct(F.array_append(acc["used"], F.coalesce(header, F.lit(""))).alias("used"),
                        F.concat(acc["chosen"], F.array(row)).cast(chosen_type).alias("chosen"))

    def take(acc: Column, f: Column) -> Column:
        free = F.filter(candidates, lambda c: (c["field"] == f["field"]) & ~F.array_contains(acc["used"], c["header"]))
        # a one-element transform names the pick, so it is looked up once per field
        return F.get(F.transform(F.array(F.get(free, F.lit(0))), lambda pick: settle(acc, f, pick)), F.lit(0))

    return F.aggregate(fields, start, take, lambda acc: acc["chosen"])


def assign_headers(headers: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """One row per feed and canonical field: the header it got (or null) and how.

    ``overrides (feed, [dataset,] field, header)`` pin fields first; a null or empty header clears the field. Two fields may be
    pinned to one header; pins on fields the dataset does not have are ignored.
    """
    spark = headers.sparkSession
    order = [F.col("stage"), F.col("score").desc(), F.col("header_ord")]
    best = top_k(header_candidates(_distinct_headers(headers)), MOST_FIELDS, order, ("feed", "dataset", "field"))
    gathered = best.groupBy("feed", "dataset").agg(
        F.array_sort(F.collect_list(F.struct("field_ord", "rank", "field", "header", "stage"))).alias("candidates"))
    fields = F.broadcast(spark.createDataFrame(
        [(d, [(i, f.key) for i, f in enumerate(fields)]) for d, fields in FIELDS.items()],
        "dataset string, fields array<struct<field_ord:int,field:string>>"))
    feeds = headers.select("feed", "dataset").distinct().join(gathered, ["feed", "dataset"], "left").join(fields, "dataset")
    if overrides is None:
        feeds = feeds.withColumn("pinned", F.create_map().cast("map<string,string>"))
    else:
        keys = [c for c in ("feed", "dataset") if c in overrides.columns]
        known = overrides.join(F.broadcast(field_table(spark).select("field").distinct()), "field", "left_semi")
        pins = known.groupBy(*keys, "field").agg(F.max("header").alias("header")).groupBy(*keys).agg(
            F.map_from_entries(F.collect_list(F.struct("field", "header"))).alias("pinned"))
        feeds = feeds.join(pins, keys, "left").withColumn(
            "pinned", F.coalesce("pinned", F.create_map().cast("map<string,string>")))
    none = F.array().cast("array<struct<field_ord:int,rank:int,field:string,header:string,stage:int>>")
    folded = _fold(F.col("fields"), F.coalesce("candidates", none), F.col("pinned"))
    return feeds.select("feed", "dataset", F.inline(folded))


def unmapped_headers(headers: DataFrame, assignment: DataFrame) -> DataFrame:
    used = assignment.filter(F.col("header").isNotNull()).select("feed", "dataset", "header").distinct()
    return headers.join(used, ["feed", "dataset", "header"], "left_anti").select("feed", "dataset", "header_ord", "header")


def missing_required(assignment: DataFrame) -> DataFrame:
    needed = field_table(assignment.sparkSession).filter("required").select("dataset", "field", "label")
    return (
        assignment.filter(F.col("header").isNull()).join(F.broadcast(needed), ["dataset", "field"])
        .select("feed", "dataset", "field_ord", "label")
    )


def mapping_report(headers: DataFrame, assignment: DataFrame) -> DataFrame:
    """What is left over on both sides: headers without a field, required fields without a header."""
    left = unmapped_headers(headers, assignment).select(
        "feed", "dataset", F.lit("unmapped header").alias("issue"), F.col("header_ord").alias("ord"),
        F.col("header").alias("name"))
    right = missing_required(assignment).select(
        "feed", "dataset", F.lit("missing required field").alias("issue"), F.col("field_ord").alias("ord"),
        F.col("label").alias("name"))
    return left.unionByName(right)


def override_diff(automatic: DataFrame, final: DataFrame) -> DataFrame:
    """Number of fields per feed whose final header is not the automatic one."""
    pairs = automatic.select("feed", "dataset", "field", F.col("header").alias("auto_header")).join(
        final.select("feed", "dataset", "field", "header"), ["feed", "dataset", "field"])
    return pairs.groupBy("feed").agg(
        F.count_if(~F.col("auto_header").eqNullSafe(F.col("header"))).alias("adjusted"))


def map_headers(spark: SparkSession, dataset: str, headers: list[str],
                overrides: dict[str, str | None] | None = None) -> dict[str, str | None]:
    """Field to header of a single feed."""
    catalogue = spark.createDataFrame(
        [("feed", dataset, i, h) for i, h in enumerate(headers)] or [("feed", dataset, 0, "")],
        "feed string, dataset string, header_ord int, header string").coalesce(1)
    pins = None
    if overrides:
        pins = spark.createDataFrame([("feed", k, v) for k, v in overrides.items()],
                                     "feed string, field string, header string").coalesce(1)
    return {r["field"]: r["header"] for r in assign_headers(catalogue, pins).collect()}
