"""Near-duplicate groups against all pairs."""

import random

import pytest
from brute import awkward, empty, near_duplicate_groups

from tallyspark.llm import neardup
from tallyspark.llm.common import components
from tallyspark.llm.neardup import drop_near_duplicates, near_duplicates

SF = "/root/testdata/sf0.001"


def found(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    want = near_duplicate_groups([(r.doc_id, r["text"]) for r in docs.collect() if r.doc_id is not None])
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == want
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None)


def test_empty_table(spark):
    assert near_duplicates(empty(spark)).collect() == []


def test_whole_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert found(near_duplicates(docs)) == near_duplicate_groups([(r.doc_id, r.text) for r in docs.collect()])


@pytest.mark.parametrize("crowd", [False, True])
def test_crowd_of_near_copies(spark, monkeypatch, crowd):
    """One crowd with pairs on both sides of the limit, also when its regions are too large and must deepen."""
    if crowd:
        monkeypatch.setattr(neardup, "REGION", 16)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(160)]
    docs = []
    for d in range(120):
        own = list(base)
        for _ in range(rng.randint(0, 6)):
            own[rng.randrange(len(own))] = f"x{rng.randrange(10**6)}"
        docs.append((d, " ".join(own)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert found(near_duplicates(df)) == near_duplicate_groups(docs)


def test_links_inside_a_large_crowd(spark):
    """Thousands of sets at 0.75 to 0.847 from one template, with pairs just over the limit among them; sizes of two classes."""
    rng = random.Random(5)
    template = [f"t{i}" for i in range(192)]  # 188 shingles; a tail of k words adds k, c of them shared by a pair
    docs, want = [], {}
    for pair in range(2200):
        ka, kb = rng.randint(17, 30), rng.randint(17, 30)
        c = 0
        if pair < 800:
            c = next(c for c in range(99) if 100 * (188 + c) >= 85 * (188 + ka + kb - c))
            c = min(c + rng.randint(0, 2), ka, kb)
        a = len(docs)
        for d, k in ((a, ka), (a + 1, kb)) if c else ((a, ka),):
            docs.append((d, " ".join(template + [f"p{pair}x{i}" for i in range(c)] + [f"d{d}x{i}" for i in range(k - c)])))
            want[d] = (188 + k, a)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert len(docs) == 3000 and found(near_duplicates(df)) == want


def test_one_document_of_each_group_stays(spark):
    docs = awkward(spark).where("doc_id is not null")
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4, 5, 6, 7, 9, 10, 12]


def test_rows_are_dropped_whatever_their_id(spark):
    """Repeated rows, null ids, and another text under an id that goes."""
    base = [f"w{i}" for i in range(100)]  # 96 shingles; ten more words give 96 / 106 = 0.91, twenty 96 / 116 = 0.83
    text, near, far = (" ".join(base + [f"{n}x{i}" for i in range(n)]) for n in (0, 10, 20))
    rows = [(1, text), (1, text), (2, near), (2, "some text of its own"), (None, text), (None, "twice without an id"),
            (None, "twice without an id"), (3, None), (4, far), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    order = lambda own: sorted(own, key=str)
    want = [(1, text), (2, "some text of its own"), (None, "twice without an id"), (3, None), (3, None)]
    assert order(map(tuple, drop_near_duplicates(docs).collect())) == order([*want, (4, far)])
    assert order(map(tuple, drop_near_duplicates(docs, 80).collect())) == order(want)


def test_components_of_a_path_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 40)] + [(7, 7), (3, 2)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(31)} | {100 + i: 100 for i in range(40)}
