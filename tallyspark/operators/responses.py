"""Typed summaries out of stored JSON responses, and note lines out of free text.

A response may hold its array fields as real arrays, as JSON text of an array, or broken; whatever can be read is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import trim_blanks
from ..functions.text import note_line


def _text(v: Column) -> Column:
    """A variant's text if it is a JSON string, else null (numbers are not turned into text)."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def _member(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _items(v: Column) -> Column:
    """Elements of an array variant or of the array written out inside a string; empty for anything else."""
    inner = F.try_parse_json(_text(v))
    found = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.try_variant_get(inner, "$", "array<variant>"))
    return F.coalesce(found, F.array().cast("array<variant>"))


def coerce_summaries(df: DataFrame, json_column: str) -> DataFrame:
    """Adds headline, sections, recommendations and whether the summary is usable as a whole."""
    parsed = F.try_parse_json(F.col(json_column))
    section_type = "array<struct<heading:string,bullets:array<string>>>"
    bullets = lambda s: F.filter(
        F.transform(_items(_member(s, "bullets")), _text), lambda b: b.isNotNull() & (trim_blanks(b) != ""))
    sections = F.filter(
        F.transform(_items(_member(F.col("_doc"), "sections")),
                    lambda s: F.struct(_text(_member(s, "heading")).alias("heading"), bullets(s).alias("bullets"))),
        lambda s: s["heading"].isNotNull() & (F.size(s["bullets"]) > 0)).cast(section_type)
    recommendations = F.filter(
        F.transform(_items(_member(F.col("_doc"), "recommendations")),
                    lambda r: F.struct(_text(_member(r, "title")).alias("title"),
                                       _text(_member(r, "detail")).alias("detail"),
                                       F.coalesce(_text(_member(r, "relatedKpi")), F.lit("")).alias("relatedKpi"))),
        lambda r: r["title"].isNotNull() & r["detail"].isNotNull())
    out = df.withColumn("_doc", parsed).select(
        *df.columns, F.coalesce(_text(_member(F.col("_doc"), "headline")), F.lit("")).alias("headline"),
        sections.alias("sections"), recommendations.alias("recommendations"))
    return out.withColumn("usable", (F.col("headline") != "") & (F.size("sections") > 0)
                          & (F.size("recommendations") > 0))


def usable_summaries(summaries: DataFrame) -> DataFrame:
    return summaries.filter("usable")


def rejected_summaries(summaries: DataFrame) -> DataFrame:
    return summaries.filter(~F.col("usable"))


def note_lines(df: DataFrame, text_column: str, keys: list[str]) -> DataFrame:
    """One row per non-blank line of a text, without its bullet or number."""
    lines = df.select(*keys, F.posexplode(F.split(F.col(text_column), "\n")).alias("line_no", "line"))
    return lines.withColumn("line", note_line(F.col("line"))).filter(F.col("line") != "")
