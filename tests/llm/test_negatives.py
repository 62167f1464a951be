"""Hard negatives against plain products of whole numbers."""

import math
import random

import numpy as np
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from tallyspark.llm import negatives as module
from tallyspark.llm import queries
from tallyspark.llm.negatives import Packed, first_places, mine_negatives

SF = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, label int, embedding array<double>, row string, score string, EMBEDDING string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)


def brute(rows, every=100, scale=256, positives=5, negatives=10):
    own = []
    for i, label, v in rows:
        if i is None or label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        own.append((i, label, [max(-2**31 + 1, min(2**31 - 1, math.floor(scale * x))) for x in v]))
    out = []
    for i, label, v in own:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, other) for j, other, w in own if j != i and len(w) == len(v))
        for p, j, _ in [s for s in scored if s[2] == label][:positives]:
            fit = [s for s in scored if s[2] != label and 30 * -p <= 100 * -s[0] <= 90 * -p][:negatives]
            out += [(i, j, rank, k, -p, -s) for rank, (s, k, _) in enumerate(fit, 1)]
    return sorted(out)


def found(df):
    return sorted(tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())


@pytest.mark.parametrize("size, most", [(1, 5), (7, 300), (64, 2**15), (3, 2**31 - 1), (64, 2**31 - 1)])
def test_packed_products_are_exact(size, most):
    rng = np.random.default_rng(size)
    x = rng.integers(-most, most + 1, (1100, size)).astype("<i4")
    a = rng.integers(-most, most + 1, (4, size)).astype("<i4")
    a[0], x[0] = -most, -most
    packed = Packed(x, a)
    assert packed.field == {5: 4, 300: 4, 2**15: 8, 2**31 - 1: 16}[most] and len(packed.wide) == 3
    for v in a:
        want = [sum(int(p) * int(q) for p, q in zip(v, w)) for w in x]
        assert [int(s) for s in packed.scores(v)] == want
    assert Packed(abs(x), abs(a)).bias == 0


def test_first_places_keep_ties_in_order():
    scores = np.array([5, 9, 9, 1, 9, 5, 7])
    assert first_places(scores, np.arange(7), 4).tolist() == [1, 2, 4, 6]
    assert first_places(scores, np.array([0, 3, 5]), 2).tolist() == [0, 5]
    assert first_places(scores.astype(object), np.arange(7), 5).tolist() == [1, 2, 4, 6, 0]
    assert first_places(scores, np.array([], dtype=int), 5).tolist() == []


@pytest.mark.parametrize("block, chunk, packed", [(8192, 1024, 512), (17, 2, 5)])
def test_against_plain_products(spark, monkeypatch, block, chunk, packed):
    """Ties, repeated vectors, rows that take no part, two lengths; one block and many."""
    monkeypatch.setattr(module, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(module, "PACKED", packed)
    rng = random.Random(8)
    rows = [(i, rng.choice([0, 0, 0, 1, 2]), [rng.choice([-1.0, -0.5, 0.25, 0.5, 1.0, rng.random()]) for _ in range(4)]) for i in range(150)]
    rows += [(i, 1, rows[i - 200][2]) for i in range(200, 320)] + [(400 + i, i % 2, [rng.random(), rng.random()]) for i in range(40)]
    rows += [(500, 0, None), (600, None, [0.5] * 4), (None, 0, [0.5] * 4), (700, 0, [0.5, None, 0.5, 0.5]), (800, 1, [float("nan")] * 4),
             (900, 1, [float("-inf"), 0.0, 0.0, 0.0]), (-100, 0, [-0.3, 0.2, 0.9, -0.1]), (1000, 1, [0.0] * 4), (1100, 0, []), (1101, 0, []),
             (1102, 1, [])]
    got = found(mine_negatives(table(spark, rows).repartition(3), block_rows=block))
    assert got == brute(rows) and len({r[0] for r in got}) >= 7


def test_large_components(spark):
    """Products beyond 64 bits are ordered exactly and cut to a long's ends only in the result."""
    rng = random.Random(9)
    rows = [(i, i % 2, [rng.uniform(0.5, 1) * 4e6 for _ in range(6)]) for i in range(120)] + [(200, 0, [1e300] * 6)]
    got = found(mine_negatives(table(spark, rows)))
    cut = lambda s: max(-2**63 + 1, min(2**63 - 1, s))
    want = sorted((*r[:4], cut(r[4]), cut(r[5])) for r in brute(rows) if cut(r[4]) == r[4])
    assert [r for r in got if r[4] < 2**63 - 1] == want and len(got) > 0


def test_repeated_rows_are_rows_of_their_own(spark):
    rows = [(100, 0, [1.0, 0.5]), (100, 0, [1.0, 0.5]), (1, 0, [1.0, 1.0]), (1, 0, [1.0, 1.0]), (2, 1, [0.5, 0.5]), (2, 1, [0.5, 0.5])]
    assert found(mine_negatives(table(spark, rows))) == brute(rows)
    assert len(brute(rows)) == 8


def test_empty_tables_and_no_anchor(spark):
    assert mine_negatives(table(spark, [])).collect() == []
    assert mine_negatives(table(spark, [(1, 0, [1.0]), (2, 1, [1.0])])).collect() == []
    assert mine_negatives(table(spark, [(100, 0, [1.0]), (2, 1, [1.0])])).collect() == []


def test_moved_labels(spark):
    rows = [(i, i % 3, [math.sin(i * k) for k in range(1, 9)]) for i in range(300)]
    moved = [(i, (c + 1) % 10 if i % 7 == 0 else c, v) for i, c, v in rows]
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    assert found(mine_negatives(table(spark, rows), label=label)) == brute(moved) != brute(rows)


def test_query_against_sql(spark):
    name = "op13_hard_negatives"
    assert compare(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF) is None
