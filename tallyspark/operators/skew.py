"""Joins in which a few keys hold much of the left side: only those are split, by a salt, the others keep one place.

A frequent-items sketch finds the hot keys in one pass over the key columns: every task keeps a bounded summary, summaries are
merged, and at most ``MAX_HOT`` keys come back. Rows of a hot key are dealt over ``SPREAD`` places for each shuffle partition,
and the right side's rows of that key, and of no other, are repeated for each place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.schema import ORD
from ..spark_tools import shuffle_parts

MAX_HOT = 64
TRACKED = 4096
SPREAD = 16
MAX_PLACES = 4096
HOWS = ("inner", "left", "left_semi", "left_anti")


def key_hash(columns: list[str]) -> Column:
    """Hash of a key; keys of one hash are split together, which changes no result."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns])


def hot_keys(rows: DataFrame, columns: list[str], share: float | None = None) -> list[int]:
    """Hashes of the keys that hold more than ``share`` of the rows, half a shuffle partition by default; heaviest first.

    The sketch misses no key whose share is above 1 / (0.75 * ``TRACKED``). Rows with a null in the key match nothing and
    are left out. An empty table has no hot key.
    """
    share = 0.5 / shuffle_parts(rows.sparkSession) if share is None else share
    keys = rows.select(*[F.col(f"`{c}`") for c in columns]).dropna()
    found = keys.select(key_hash(columns).alias("key")).agg(
        F.expr(f"approx_top_k(key, {MAX_HOT}, {TRACKED})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return [r["item"] for r in found["top"] or [] if r["count"] > share * found["n"]]


def skew_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot: list[int] | None = None,
              spread: Column | None = None) -> DataFrame:
    """``left.join(right, on, how)`` whose hot keys are split; ``hot`` are their hashes if they are known already.

    ``spread`` is a value of the left rows that differs within a key and stays the same when a task is run again: the file
    position where there is one, else a hash of the row, which leaves equal rows together. Nulls in a key match nothing, as
    in a plain join; a left row with one stays in a left or anti join.
    """
    if how not in HOWS:
        raise ValueError(f"{how!r} is none of {HOWS}: rows of the right side that match nothing would be repeated")
    kinds = {c: (left.schema[c].dataType, right.schema[c].dataType) for c in on}
    if unlike := {c: k for c, k in kinds.items() if k[0] != k[1]}:
        raise ValueError(f"key columns of different types have different hashes: {unlike}")
    hot = hot_keys(left, on) if hot is None else hot
    if not hot:
        return left.join(right, on, how)
    places = min(MAX_PLACES, SPREAD * shuffle_parts(left.sparkSession))
    if spread is None:
        spread = F.col(ORD) if ORD in left.columns else F.struct(*[F.col(f"`{c}`") for c in left.columns])
    is_hot = key_hash(on).isin(hot)
    split = left.withColumn("_place", F.when(is_hot, F.pmod(F.xxhash64(spread), F.lit(places))).otherwise(F.lit(0)))
    zero = F.lit(0).cast("bigint")
    every = F.when(is_hot, F.sequence(zero, F.lit(places - 1).cast("bigint"))).otherwise(F.array(zero))
    repeated = right.withColumn("_place", F.explode(every))
    return split.join(repeated, [*on, "_place"], how).drop("_place")
