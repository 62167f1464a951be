"""Periodic runs against a plain search over all periods."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from brute import awkward, empty
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyspark.llm import queries
from tallyspark.llm import runs as module
from tallyspark.llm.runs import Ranks, WaveletMatrix, _search, periodic_runs, progressions

SF = "/root/testdata/sf0.001"


def brute_runs(w):
    """(start, length, period) by start and period: stretches of places that equal the one q on, smallest q first."""
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i + q - start >= max(6, 4 * q):
                out.setdefault((start, i + q - start), q)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(w):
    gone = {i for s, n, q in brute_runs(w) for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def searched(texts):
    sizes, per_text, runs, collapsed = _search([None if t is None else t.encode() for t in texts])
    rows, at = [(r["start"], r["length"], r["period"]) for r in runs.to_pylist()], np.append(0, np.cumsum(per_text)).tolist()
    return [(n, rows[low:high], c.decode()) for n, low, high, c in zip(sizes, at, at[1:], collapsed)]


def wanted(texts):
    return [(len(words_of(t)), brute_runs(words_of(t)), brute_collapsed(words_of(t))) for t in texts]


pieces = st.lists(st.tuples(st.lists(st.sampled_from("abc"), min_size=1, max_size=7), st.integers(1, 9)), max_size=6)


@settings(max_examples=300, deadline=None)
@given(st.lists(pieces, min_size=1, max_size=4))
def test_texts_of_powers(parts):
    texts = [" ".join(x for word, times in text for x in word * times) for text in parts]
    assert searched(texts) == wanted(texts)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="ab", max_size=60), min_size=1, max_size=3))
def test_words_of_two_letters(texts):
    texts = [" ".join(t) for t in texts]
    assert searched(texts) == wanted(texts)


def test_nested_and_neighbouring_runs():
    """Runs inside a run's period, runs that overlap by less than a period, periods at powers of two and beside them."""
    texts = [" ".join((["a"] * 7 + ["b"]) * 5), " ".join((["a", "b"] * 4 + ["c"]) * 6 + ["a", "b"] * 9)]
    for q in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 63, 64, 65):
        word = [f"w{i % 5 if i % 3 else i}" for i in range(q)]
        for extra in (-1, 0, 1):
            for lead in (0, 1, 5):
                texts.append(" ".join([f"l{i}" for i in range(lead)] + (word * 5)[:4 * q + extra] + ["end"]))
    got = searched(texts)
    assert got == wanted(texts) and sum(len(r) for _, r, _ in got) > 100


def test_texts_do_not_meet_each_other():
    same = "x y z x y z x y"
    assert [len(r) for _, r, _ in searched([same, same, same + " z", same + " z x y z"])] == [0, 0, 0, 1]


def test_extensions_and_blocks():
    rng = random.Random(1)
    own = [rng.randint(1, 2) for _ in range(200)]
    words = np.array([*own, 0, *own[:90], 0])
    text = np.repeat([0, 1], [201, 91])
    first = np.repeat([0, 201], [201, 91])
    ranks = Ranks(words, text, first, 200)
    i = np.array([rng.randrange(0, 100) for _ in range(300)])
    j = i + np.array([rng.randrange(1, 90) for _ in range(300)])
    ahead = lambda a, b: next(k for k in range(300) if words[a + k] != words[b + k] or b + k >= 200)
    behind = lambda a, b: next(k for k in range(300) if a - k == 0 or words[a - k - 1] != words[b - k - 1])
    assert ranks.ahead(i, j).tolist() == [ahead(a, b) for a, b in zip(i, j)]
    assert ranks.behind(i, j, np.zeros(300, dtype=int)).tolist() == [behind(a, b) for a, b in zip(i, j)]
    for level, (place, low, high) in enumerate(ranks.blocks):
        m = 1 << level
        for p, a, b in zip(place.tolist(), low.tolist(), high.tolist()):
            assert (p - first[p]) % m == 0
            last = 200 if p < 201 else 291
            same = [s for s in range(first[p], last - m + 1) if (words[s:s + m] == words[p:p + m]).all()]
            assert sorted(ranks.slots[a:b].tolist()) == same and len(same) > 1


def test_occurrences_in_a_window_are_a_progression():
    """What the range successor queries name is all the occurrences in each window."""
    rng = random.Random(3)
    for _ in range(60):
        own = []
        while len(own) < 120:
            own += [rng.randint(1, 3) for _ in range(rng.randint(1, 5))] * rng.randint(1, 8)
        words = np.array([*own, 0])
        n = len(own)
        first, size = np.zeros(n + 1, dtype=np.int64), np.full(n + 1, n)
        ranks = Ranks(words, first, first, n)
        matrix = WaveletMatrix(ranks.slots - first[ranks.slots], (n + 1).bit_length())
        for level in range(len(ranks.levels)):
            m = 1 << level
            got = {b: [p + k * d for k in range(c)] for b, p, d, c in zip(*(x.tolist() for x in progressions(ranks, matrix, level, first, size)))}
            want = {b: [s for s in range(b + m, b + 2 * m) if own[s:s + m] == own[b:b + m] and s + m <= n] for b in range(0, n - m + 1, m)}
            assert got == {b: s for b, s in want.items() if s}


def test_wavelet_matrix_against_sorting():
    rng = np.random.default_rng(4)
    values = rng.integers(0, 100, 300)
    matrix = WaveletMatrix(values, 7)
    low = rng.integers(0, 300, 500)
    high = np.minimum(300, low + rng.integers(0, 60, 500))
    x = rng.integers(0, 120, 500)
    for a, b, v, below, nxt in zip(low, high, x, matrix.below(low, high, x), matrix.successor(low, high, x, 999)):
        own = np.sort(values[a:b])
        assert below == (own < v).sum()
        assert nxt == (own[own >= v].min() if (own >= v).any() else 999)


def test_awkward_rows(spark):
    docs = awkward(spark)
    rows = docs.collect()
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(docs).collect()))
    want = []
    for r in rows:
        w = words_of(r["text"])
        runs = [(0, 30_000, 1)] if r.doc_id == 9 else brute_runs(w)
        want.append((r.doc_id is None, r.doc_id or 0, len(w), runs, "lorem" if r.doc_id == 9 else brute_collapsed(w)))
    assert got == sorted(want)
    assert periodic_runs(empty(spark)).collect() == []


def test_blanks_are_the_six_only(spark):
    odd = "\x1c \x85 \xa0   a\x1cb"
    df = spark.createDataFrame([(1, odd), (2, "p\tq\np\x0bq\x0cp\rq  p q p q")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic_runs(df).collect()}
    assert got[1].n_words == 5 and got[1].collapsed == odd
    assert [tuple(x) for x in got[2].runs] == [(0, 10, 2)] and got[2].collapsed == "p q"


def test_a_very_long_text(spark, monkeypatch):
    """A text far beyond a batch, with a period of its own between short ones."""
    monkeypatch.setattr(module, "BATCH_WORDS", 1000)
    word = [f"w{i}" for i in range(5000)]
    long = ["head"] * 9 + word * 6 + ["tail"]
    assert searched(["a b", " ".join(long), "c " * 7]) == [
        (2, [], "a b"), (30_010, [(0, 9, 1), (9, 30_000, 5000)], " ".join(["head", *word, "tail"])), (7, [(0, 7, 1)], "c")]


def planted(doc_id, text):
    own = words_of(text)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not own:
        return own
    n, g = len(own), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]


def test_query_against_brute_force(spark):
    """The whole smallest table; texts too long for a plain search of all periods are compared with their checksums' parts only."""
    docs = {r.doc_id: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = queries.op11_periodic_runs(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        own = planted(r.doc_id, docs[r.doc_id])
        runs = brute_runs(own)
        assert r.n_runs == len(runs) and r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs))
        assert r.collapsed_sha256 == sha(brute_collapsed(own))
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None, None, None))
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
    assert sum(r.n_runs > 0 for r in rows) > 10


@pytest.mark.parametrize("text", [None, "", " \n", "one", "a b c d e f g h i j"])
def test_planting_on_short_texts(spark, text):
    df = spark.createDataFrame([(i, text) for i in range(60)] + [(None, text)], "doc_id long, text string")
    for r in queries.with_planted_periods(df).collect():
        want = text if r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 10 or not words_of(text) else " ".join(planted(r.doc_id, text))
        assert r["text"] == want
