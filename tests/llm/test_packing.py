"""Packed sequences: every id in exactly one piece, little padding, neighbours that fit."""

import random
from collections import defaultdict

import numpy as np
from brute import awkward, empty

from tallyspark.llm.packing import ShardIndex, fill_windows, pack_documents
from tallyspark.llm.tokens import load, tokenizer_file


def tokenizer():
    with open(tokenizer_file(), encoding="utf-8") as f:
        return load(f.read())


def test_pieces_cover_every_document_once(spark):
    docs = awkward(spark)
    rows = pack_documents(docs, window=256).collect()
    whole = tokenizer().full
    want = sorted((r.doc_id is None, r.doc_id or 0, [*whole.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in docs.collect())
    by_row = defaultdict(list)
    for r in rows:
        by_row[r.doc_id].append(r)
    got = []
    for d, own in by_row.items():
        copies = 2 if d == 11 else 1
        for start in {r.start for r in own}:
            assert sum(r.start == start for r in own) == copies or copies == 2
        own.sort(key=lambda r: (r.sequence_id, r.offset))
        rest = list(own)
        for _ in range(copies):
            at, ids = 0, []
            while at < own[0].doc_tokens:
                piece = next(r for r in rest if r.start == at)
                rest.remove(piece)
                ids += np.frombuffer(piece.ids, "<u4").tolist()
                at += len(piece.ids) // 4
            got.append((d is None, d or 0, ids))
        assert not rest
    assert sorted(got) == want


def test_sequences_are_full_but_the_last(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = pack_documents(docs, shard_tokens=100_000).collect()
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, len(r.ids) // 4))
    short = defaultdict(int)
    for s, own in filled.items():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        short[s >> 32] += at < 2048
    assert max(short.values()) <= 1 and len(short) > 1


def test_empty_table(spark):
    assert pack_documents(empty(spark)).collect() == []


def test_bm25_of_a_shard_against_the_formula():
    docs = [np.array(x, dtype=np.uint16) for x in ([1, 2, 2, 5], [2, 3], [7, 8, 9], [2, 5, 5, 5, 6, 1])]
    idf = np.linspace(0.1, 1, 10)
    index = ShardIndex(docs, idf, mean_length=3.5)
    for i, ask in enumerate(docs):
        want = [sum(idf[t] * (d == t).sum() * 2.2 / ((d == t).sum() + 1.2 * (0.25 + 0.75 * len(d) / 3.5)) for t in set(ask.tolist()) if (d == t).any())
                for d in docs]
        assert np.allclose(index.scores(i), want)


def test_neighbours_share_a_window():
    rng = np.random.default_rng(1)
    docs = [rng.integers(100 * (i % 2), 100 * (i % 2) + 60, 40).astype(np.uint16) for i in range(40)]
    windows = defaultdict(set)
    for i, _, _, seq, _ in fill_windows(list(range(40)), docs, ShardIndex(docs, np.ones(200), 40), 120):
        windows[seq].add(i % 2)
    assert sum(len(w) == 1 for w in windows.values()) >= len(windows) - 1


def test_copies_of_one_id_do_not_share_a_window():
    docs = [np.arange(10, dtype=np.uint16)] * 4 + [np.arange(5, 15, dtype=np.uint16)] * 4
    seen = defaultdict(list)
    names = [0, 0, 0, 0, 1, 2, 3, 4]
    for i, _, _, seq, _ in fill_windows(names, docs, ShardIndex(docs, np.ones(20), 10), 20):
        seen[seq].append(names[i])
    assert all(len(set(own)) == len(own) for own in seen.values())


def test_cached_ids_equal_the_tokenizer():
    pool = ["a", "É", "ß", "İ", "Σ", "σς", "'s", "'LL", "don't", "\u0301", "e\u0301", "क़", "한", "ᄒ", "<|endoftext|>", " ", "\n", "\x1c", "\x85",
            "\xa0", "12", "²", "...", "!?", "😀", "_", "ab_c", "ﬁ", "日本語", " "]
    rng = random.Random(5)
    texts = ["".join(rng.choice(pool) for _ in range(rng.randint(1, 12))) for _ in range(3000)]
    tok = tokenizer()
    want = [e.ids for e in tok.full.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, tok.dtype).tolist() for x in tok.encode(texts)] == want
    assert tok.encode([None, ""]) == [b"", b""]
