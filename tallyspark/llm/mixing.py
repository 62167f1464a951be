"""Temperature mixing of sources; DataFrame functions only.

A source's share of tokens is raised to an exponent between 0 (all sources alike) and 1 (as they are) and normalised. The
exponent is bisected until the weights have a target entropy or until no source is repeated more often than a limit. The
weights become whole documents through budgeted block permutations: a source is dealt into blocks of about
``BLOCK_TOKENS`` tokens, a block is permuted by hash, and gives each document once per whole epoch and the first ones of
the permutation once more, as far as the block's share of the budget goes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import numbered, stage

BLOCK_TOKENS = 100_000
REPEAT_LIMIT = 2.0
SECTIONS = 32
MIX = ("mix_tokens", "mix_weight", "mix_rate", "mix_block", "mix_copies")
WORD = r"[^ \t\n\x0B\f\r]+"


def token_count(text: Column) -> Column:
    """Words of a text and one for its end; 1 for a null text."""
    return (F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)) + 1).cast("long")


def source_key(source: Column) -> Column:
    """A null source is a source of its own."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))


def draw(doc_id: Column, seed: int) -> Column:
    """A number of 60 bits from the seed and the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def bisect_exponent(sizes: DataFrame, entropy: float | None = None, repeat_limit: float = REPEAT_LIMIT,
                    budget_tokens: int | None = None) -> tuple[float, float]:
    """(exponent, sum of shares to that exponent) for a table (key, tokens) of sources.

    With ``entropy`` (in nats) the exponent whose weights have it, else the smallest one at which no source is repeated more
    than ``repeat_limit`` times. Each round halves the interval five times in one pass over the sources, of which only sums
    reach the driver. A target out of reach gives the nearest end of the interval.
    """
    total, low_share, high_share, n = sizes.agg(F.sum("tokens"), F.min("tokens"), F.max("tokens"), F.count(F.lit(1))).first()
    if not n:
        return 1.0, 1.0
    low_share, high_share = low_share / total, high_share / total
    share = F.col("tokens") / F.lit(float(total))

    def sums(points: list[float]) -> list[tuple[float, float]]:
        row = sizes.agg(*(x for a in points for x in (F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share))))).first()
        return [(row[2 * i], row[2 * i + 1]) for i in range(len(points))]

    def too_flat(a: float, z: float, zl: float) -> bool:
        if entropy is not None:
            return math.log(z) - a * zl / z > entropy
        if budget_tokens is None:  # the largest source counts once
            return (low_share / high_share) ** (a - 1) > repeat_limit
        return budget_tokens / total * low_share ** (a - 1) / z > repeat_limit

    low, high = 0.0, 1.0
    if not too_flat(0.0, *sums([0.0])[0]):
        high = 0.0
    while high - low > 1e-9:
        points = [low + (high - low) * i / SECTIONS for i in range(1, SECTIONS)]
        flat = [too_flat(a, *s) for a, s in zip(points, sums(points))]
        k = sum(flat)
        low, high = points[k - 1] if k else low, points[k] if k < len(points) else high
    exponent = math.floor(high * 1e6 + 0.5) / 1e6
    return exponent, sums([exponent])[0][0]


def free_names(columns: list[str]) -> list[str]:
    """Names of the columns of the mix, with as many underscores in front as keep them apart from ``columns``."""
    taken, prefix = {c.lower() for c in columns}, ""
    while taken & {prefix + c for c in MIX}:
        prefix += "_"
    return [prefix + c for c in MIX]


def mix_sources(docs: DataFrame, entropy: float | None = None, repeat_limit: float = REPEAT_LIMIT,
                budget_tokens: int | None = None, block_tokens: int = BLOCK_TOKENS, seed: int = 17) -> DataFrame:
    """``docs`` with mix_tokens, mix_weight, mix_rate, mix_block and mix_copies (how often the document is taken) as last columns.

    Where ``docs`` has a column of such a name, in any case, it stays and all five new ones get underscores in front.
    Without ``budget_tokens`` the budget is the least at which every source is taken whole, so nothing is dropped. A null source
    is one of its own, a null text has one token; repeated rows are counted and taken one by one; an empty table stays empty.
    """
    plain, at = numbered(docs)
    rows = plain.withColumns({"mix_tokens": token_count(F.col(at["text"])), "mix_key": source_key(F.col(at["source"]))})
    sizes = stage(rows.groupBy("mix_key").agg(F.sum("mix_tokens").alias("tokens")), "sources")
    exponent, z = bisect_exponent(sizes, entropy, repeat_limit, budget_tokens)
    total, largest = sizes.agg(F.sum("tokens"), F.max("tokens")).first()
    total, largest = total or 1, largest or 1
    weight = F.pow(F.col("tokens") / F.lit(float(total)), F.lit(exponent)) / F.lit(z)
    budget = F.lit(float(budget_tokens)) if budget_tokens is not None else F.lit(largest / ((largest / total) ** exponent / z))
    plan = sizes.select(F.col("mix_key").alias("mix_of"), weight.alias("mix_weight"),
                        (F.floor(budget * weight / F.col("tokens") * 1e9 + 0.5) / 1e9).alias("mix_rate"),
                        F.ceil(F.col("tokens") / block_tokens).alias("mix_blocks"))
    rows = rows.withColumn("mix_draw", draw(F.col(at["doc_id"]), seed))
    rows = rows.join(plan, F.col("mix_key") == F.col("mix_of")).withColumn("mix_block", F.col("mix_draw") % F.col("mix_blocks"))
    block = Window.partitionBy("mix_key", "mix_block")
    order = block.orderBy("mix_draw", at["doc_id"], "mix_tokens").rowsBetween(Window.unboundedPreceding, 0)
    # Twice the middle of the document against twice the block's share of the last, partial epoch.
    middle = 2 * F.sum("mix_tokens").over(order) - F.col("mix_tokens")
    whole = F.floor("mix_rate")
    extra = middle <= 2 * (F.col("mix_rate") - whole) * F.sum("mix_tokens").over(block)
    out = rows.withColumn("mix_copies", (whole + extra.cast("int")).cast("long"))
    return out.select(*plain.columns, *MIX).toDF(*docs.columns, *free_names(docs.columns))


def take_copies(mixed: DataFrame) -> DataFrame:
    """The documents of ``mix_sources`` as often as the mix takes them, without the five columns of the mix."""
    plain, _ = numbered(mixed)
    own = mixed.columns[:-len(MIX)]
    copies = F.col(plain.columns[-1])
    many = plain.where(copies > 0).withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    return many.select(*plain.columns[:len(own)]).toDF(*own)
