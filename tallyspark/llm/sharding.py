"""Sharding by extendible hashing; DataFrame functions only.

A shard is a prefix of hash bits. One shard holds all rows at first; a shard over its byte limit splits on one more bit, the
others stay. Which prefixes split is found on sums of bytes by prefix, several bits in one pass; only rows of shards that
are still too large go on to further bits. The directory maps every prefix of the deepest shard's length to its shard.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import pick, stage

SHARD_BYTES = 1 << 20
BITS = 60
STEP = 4


def hash_bits(key: Column) -> Column:
    """60 bits of the MD5 of a key; a null key counts as empty text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def _prefix(depth: int) -> Column:
    """The first ``depth`` of 120 bits: those of the key, then those of the row for rows that share a key."""
    if depth <= BITS:
        return F.shiftright("h1", BITS - depth).cast("string")
    return F.concat_ws("-", "h1", F.shiftright("h2", 2 * BITS - depth))


def _bits(depth: int) -> Column:
    first = F.lpad(F.conv(F.shiftright("h1", max(0, BITS - depth)).cast("string"), 10, 2), min(depth, BITS), "0") if depth else F.lit("")
    if depth <= BITS:
        return first
    return F.concat(first, F.lpad(F.conv(F.shiftright("h2", 2 * BITS - depth).cast("string"), 10, 2), depth - BITS, "0"))


def shard_documents(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, bytes, shard, depth, shard_bytes, shard_rows), one row per row of ``docs``.

    ``shard`` is the shard's hash prefix as text of ``depth`` bits. Every shard holds at most ``shard_bytes`` bytes of text,
    or a single row that is larger by itself. Null and empty texts have no byte; rows that share an id, also a null one, are
    told apart by their row number, so they too split. An empty table gives no row.
    """
    src = pick(docs, "doc_id", "text")
    rows = src.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), hash_bits(F.col("doc_id")).alias("h1"),
                      hash_bits(F.concat_ws("#", F.monotonically_increasing_id(), F.lit("row"))).alias("h2"))
    rows = stage(rows, "rows")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    low, high = 0, min(BITS, max(1, math.ceil(math.log2(max(1.0, total / shard_bytes)))) + 3)
    left, found = rows, None
    while True:
        depths = range(low if low == 0 else low + 1, high + 1)
        cells = left.groupBy(_prefix(high).alias("cell")).agg(F.sum("bytes").alias("b"), F.count(F.lit(1)).alias("n"),
                                                              F.first("h1").alias("h1"), F.first("h2").alias("h2"))
        cells = stage(cells, "cells")
        every = cells.select("cell", "b", "n", F.explode(F.array(*(F.struct(F.lit(d).alias("depth"), _bits(d).alias("shard")) for d in depths))).alias("at"))
        every = every.select("cell", "b", "n", "at.*")
        sums = every.groupBy("depth", "shard").agg(F.sum("b").alias("sb"), F.sum("n").alias("sn")).where(
            (F.col("sb") <= shard_bytes) | (F.col("sn") == 1))
        fits = every.join(sums, ["depth", "shard"]).groupBy("cell").agg(F.min(F.struct("depth", "shard", "sb", "sn")).alias("own"))
        fits = stage(fits, "shards")
        own = left.withColumn("cell", _prefix(high)).join(fits, "cell", "left")
        done = own.where("own is not null").select("doc_id", "bytes", F.col("own.shard").alias("shard"), F.col("own.depth").alias("depth"),
                                                   F.col("own.sb").alias("shard_bytes"), F.col("own.sn").alias("shard_rows"))
        found = done if found is None else found.unionByName(done)
        if cells.join(fits, "cell", "left_anti").isEmpty() or high == 2 * BITS:
            return found
        left = stage(own.where("own is null").select("doc_id", "bytes", "h1", "h2"), "rows")
        low, high = high, min(2 * BITS, high + STEP)


def directory(sharded: DataFrame) -> DataFrame:
    """(entry, shard): the directory over prefixes of the deepest shard's length, each pointing to its shard.

    A shard of less depth fills a run of entries; a prefix without rows has no shard and no entry. For shards within the 60
    bits of the key.
    """
    shards = sharded.select("shard", "depth").distinct()
    deepest = shards.agg(F.max("depth")).first()[0] or 0
    spare = F.lit(deepest) - F.col("depth")
    first = F.conv(F.when(F.col("depth") == 0, F.lit("0")).otherwise(F.col("shard")), 2, 10).cast("long") * F.pow(F.lit(2.0), spare).cast("long")
    return shards.select(F.explode(F.sequence(first, first + F.pow(F.lit(2.0), spare).cast("long") - 1)).alias("entry"), "shard")
