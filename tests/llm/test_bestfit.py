"""Best-fit packing: every id in one piece, nothing cut without need, as few windows as a search over all finds."""

import functools
import random
from collections import defaultdict

import numpy as np
import pytest
from brute import awkward, empty

from tallyspark.llm import queries
from tallyspark.llm.bestfit import Rooms, assign, best_configuration, configurations, group_sizes, pack_best_fit
from tallyspark.llm.tokens import load, tokenizer_file

SF = "/root/testdata/sf0.001"


def tokenizer():
    with open(tokenizer_file(), encoding="utf-8") as f:
        return load(f.read())


def windows_of(lengths, number, offset, window):
    """Number of windows, after checking that each is gapless and none too full."""
    own = defaultdict(list)
    for size, n, o in zip(lengths, number, offset):
        own[n].append((o, size))
    for parts in own.values():
        at = 0
        for o, size in sorted(parts):
            assert o == at
            at += size
        assert at <= window
    assert sorted(own) == list(range(len(own)))
    return len(own)


def fewest(lengths, window):
    """Exact number of windows by trying every way."""
    @functools.cache
    def go(left, rooms):
        if not left:
            return 0
        size, best = left[0], 10**9
        for r in set(rooms):
            if r >= size:
                more = list(rooms)
                more.remove(r)
                best = min(best, go(left[1:], tuple(sorted([*more, r - size]))))
        return min(best, 1 + go(left[1:], tuple(sorted([*rooms, window - size]))))

    return go(tuple(sorted(lengths, reverse=True)), ())


@pytest.mark.parametrize("seed", range(12))
def test_few_pieces_against_every_way(seed):
    rng = random.Random(seed)
    lengths = [rng.randint(1, 30) for _ in range(rng.randint(1, 9))]
    number, offset = assign(np.array(lengths), 30)
    assert windows_of(lengths, number, offset, 30) <= fewest(lengths, 30) + 1
    best = min(windows_of(lengths, *assign(np.array(lengths), 30, (g,)), 30) for g in (1, 2, 4, 9))
    assert best == fewest(lengths, 30)


def test_configuration_program_is_optimal():
    """Sizes 5, 4 and 3 in windows of 12: 12 = 4+4+4 = 5+4+3 = 3+3+3+3 waste nothing, so the tokens are the bound."""
    sizes, demand = np.array([3, 4, 5]), np.array([30.0, 30.0, 20.0])
    basis, used = configurations(sizes, demand, 12)
    assert np.allclose(basis @ used, demand) and (sizes @ basis <= 12).all()
    assert used.sum() == pytest.approx(sizes @ demand / 12)
    assert configurations(np.array([7]), np.array([9.0]), 12)[1].sum() == pytest.approx(9)


def test_best_configuration_against_every_multiset():
    rng = random.Random(2)
    for _ in range(40):
        sizes = np.array(sorted(rng.sample(range(3, 20), 4)))
        worth = np.array([rng.random() for _ in sizes])
        every = [(a, b, c, d) for a in range(8) for b in range(8) for c in range(8) for d in range(8)
                 if a * sizes[0] + b * sizes[1] + c * sizes[2] + d * sizes[3] <= 21]
        value, count = best_configuration(sizes, worth, 21)
        assert value == pytest.approx(max(float(worth @ np.array(x)) for x in every)) and sizes @ count <= 21


def test_groups_are_of_equal_cardinality():
    lengths = np.array(sorted(random.Random(3).sample(range(1000), 100), reverse=True))
    rounded = group_sizes(lengths, 8)
    assert (rounded >= lengths).all() and set(np.unique(rounded, return_counts=True)[1]) <= {12, 13}
    assert group_sizes(lengths[:3], 8).tolist() == lengths[:3].tolist()


def test_rooms_give_the_fullest_window():
    rooms = Rooms(50)
    for number, room in enumerate((7, 20, 12, 0, 12)):
        rooms.put(number, room)
    assert [rooms.take(8)[1], rooms.take(8)[1], rooms.take(8)[1], rooms.take(8)] == [12, 12, 20, None]


@pytest.mark.parametrize("low, high", [(1, 4096), (1400, 4096), (1, 200), (2049, 4096), (1365, 1365), (4096, 4096)])
def test_windows_near_the_bound(low, high):
    rng = np.random.default_rng(1)
    lengths = rng.integers(low, high + 1, 4000)
    count = windows_of(lengths.tolist(), *assign(lengths), 4096)
    least = -(-int(lengths.sum()) // 4096)
    if low == 2049:
        least = 4000  # no two of them fit
    elif low == 1400:
        low_at, pairs, falling = 0, 0, np.sort(lengths)  # and no three: the shortest one goes with the longest it can
        for high_at in reversed(range(4000)):
            if low_at < high_at and falling[low_at] + falling[high_at] <= 4096:
                low_at, pairs = low_at + 1, pairs + 1
        least = 4000 - pairs
    elif low == 1365:
        least = -(-4000 // 3)
    assert count <= 1.01 * least
    assert len(assign(lengths[:0])[0]) == 0


def test_pieces_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = pack_best_fit(docs, window=512).collect()
    whole = tokenizer().full
    want = sorted((r.doc_id is None, r.doc_id or 0, *[*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in docs.collect())
    by_doc = defaultdict(lambda: defaultdict(list))
    for r in rows:
        assert r.start == 512 * r.piece and 0 < len(r.ids) // 4 <= 512
        by_doc[r.doc_id][r.piece].append(np.frombuffer(r.ids, "<u4").tolist())
    got = []
    for d, pieces in by_doc.items():
        copies = 2 if d == 11 else 1
        for k in range(copies):
            assert all(len(own) == copies for own in pieces.values())
            assert all(len(pieces[p][k]) == 512 for p in range(len(pieces) - 1))
            got.append((d is None, d or 0, *[i for p in range(len(pieces)) for i in pieces[p][k]]))
    assert sorted(got) == want
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, len(r.ids) // 4))
    for own in filled.values():
        assert [o for o, _ in sorted(own)] == [sum(s for _, s in sorted(own)[:i]) for i in range(len(own))]
        assert sum(s for _, s in own) <= 512


def test_empty_table(spark):
    assert pack_best_fit(empty(spark)).collect() == []


def test_query_is_near_the_bound(spark):
    rows = queries.op12_best_fit_packing(spark, SF).collect()
    total = sum(r.length for r in rows)
    assert len({r.doc_id for r in rows}) == 200
    assert len({r.sequence_id for r in rows}) <= -(-total // 4096) + 1
    assert all(r.length == 4096 for r in rows if any(o.doc_id == r.doc_id and o.piece > r.piece for o in rows))


def test_shards_are_packed_apart(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = pack_best_fit(docs, shard_rows=50).collect()
    assert len({r.sequence_id >> 32 for r in rows}) == 4
    assert {(r.doc_id, r.piece, bytes(r.ids)) for r in rows} == {(r.doc_id, r.piece, bytes(r.ids)) for r in pack_best_fit(docs).collect()}
