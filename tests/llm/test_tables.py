"""Nearest neighbours, archives, mixing, shards, fingerprints and the pipeline."""

import base64
import hashlib
import io

import numpy as np
import pytest
from brute import awkward, edited, empty, paragraph_set
from pyspark.sql import functions as F

from tallyspark.llm import queries
from tallyspark.llm.ann import Block, nearest_neighbours
from tallyspark.llm.fingerprints import CHECK, GROUP_BIT, PRIME, ROWS, WIDTH, differences, fingerprint_documents, paragraph_sets
from tallyspark.llm.mixing import bisect_exponent, mix_sources, take_copies
from tallyspark.llm.sharding import directory, shard_documents
from tallyspark.llm.warc import build_dictionary, page_of, read_archives, read_records, record_id, write_archives

SF = "/root/testdata/sf0.001"


def test_footrule_of_a_block():
    rng = np.random.default_rng(3)
    prefixes = np.stack([rng.permutation(12)[:5] for _ in range(40)]).astype(np.uint16)
    block = Block(prefixes, 12)
    for q in prefixes[:5].tolist():
        want = []
        for c in prefixes.tolist():
            place = lambda own, p: own.index(p) if p in own else 5
            want.append(sum(abs(place(q, p) - place(c, p)) for p in set(q) | set(c)))
        assert block.footrule(np.array(q)).tolist() == want


def brute_neighbours(rows, wanted=20):
    out = {}
    for q, v in rows:
        if q % 20 == 0:
            scores = sorted((-float((np.array(v) * np.array(w)).sum()), i) for i, w in rows if i != q)
            out[q] = [(i, -s) for s, i in scores[:wanted]]
    return out


def test_neighbours_of_a_small_table_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=6) * rng.uniform(0.2, 3)).tolist()) for i in range(90)]
    rows += [(100, rows[0][1]), (101, rows[0][1]), (140, rows[7][1])]
    bad = [(20_000, None), (20_020, [0.0] * 6), (20_040, [float("nan")] + [1.0] * 5), (20_060, [None] + [1.0] * 5), (None, [1.0] * 6),
           (20_080, []), (20_100, [1.0, 2.0]), (20_120, [float("inf")] * 6)]
    df = spark.createDataFrame([(*r, "x") for r in rows + bad], "vec_id long, embedding array<double>, score string")
    got = {}
    for r in sorted(nearest_neighbours(df).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute_neighbours(rows)
    assert {q: [i for i, _ in v] for q, v in got.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]]) for q in want)


def test_fewer_candidates_than_wanted(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (3, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.vec_id, r["rank"]) for r in nearest_neighbours(df).orderBy("rank").collect()] == [(3, 1), (1, 2)]
    assert nearest_neighbours(df.where("false")).count() == 0


def test_recall_on_random_vectors(spark):
    """The hardest case: no clusters at all, two blocks."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(9000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in nearest_neighbours(df, every=100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = 0
    for q, own in got.items():
        s = x @ x[q]
        s[q] = -9
        hits += len(own & set(np.argsort(-s)[:20].tolist()))
    assert len(got) == 90 and hits / (20 * len(got)) >= 0.9


def test_record_ids_hold_page_ids():
    for p in (0, 1, 2**31, 2**62 - 1, 2**62, 2**63 - 1, -1, -2**63):
        assert page_of(record_id(p)) == p
    assert page_of(record_id(None, b"x")) is None


def test_archives_round_trip(spark, tmp_path):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, "same"), (4, "http://a/4", None), (5, "http://a/5\r\nX: y", ""),
            (6, "http://é/6", "é\r\n\r\nbody " * 50_000), (None, "http://a/n", "same"), (7, "u", "own"), (7, "u", "own")]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, payload string")
    manifest = write_archives(pages, folder=str(tmp_path / "out"))
    got = sorted(((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest, r.payload)
                  for r in read_archives(manifest).collect()), key=str)
    sha = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    size = lambda t: len((t or "").encode())
    kind = {1: 3, 2: 3, None: 3, 4: 5}
    want = sorted(((p if p is not None else -1, "revisit" if p in kind else "response", kind.get(p), size(t), sha(t), None if p in kind else t or "")
                   for p, _, t in rows), key=str)
    assert got == want
    assert manifest.agg(F.sum("records")).first()[0] == len(rows)


def test_every_record_is_a_frame_of_its_own(spark, tmp_path):
    import zstandard

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in write_archives(pages, folder=str(tmp_path / "out")).collect():
        raw = open(r.path, "rb").read()
        assert raw[:4] == bytes.fromhex("5d2a4d18")
        at = 8 + int.from_bytes(raw[4:8], "little")
        table = zstandard.ZstdCompressionDict(raw[8:at])
        frames = 0
        while at < len(raw):
            plain = zstandard.ZstdDecompressor(dict_data=table).decompressobj()
            assert plain.decompress(raw[at:]).startswith(b"WARC/1.1\r\n")
            at, frames = len(raw) - len(plain.unused_data), frames + 1
        assert frames == r.records + 1 == sum(1 for _ in read_records(io.BytesIO(raw)))
        assert r.bytes < sum(len(p.html.encode()) for p in pages.collect())


def test_smaller_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "aa"), (2, "u", "aa"), (3, "u", "bbbb"), (4, "u", "bbbb")], "page_id long, url string, html string")
    got = {r.page_id: r.record_type for r in read_archives(write_archives(pages, str(tmp_path / "o"), revisit_min_bytes=3)).collect()}
    assert got == {1: "response", 2: "response", 3: "revisit", 4: "response"}
    assert write_archives(pages.where("false"), str(tmp_path / "e")).count() == 0


def test_dictionary_of_few_records():
    assert build_dictionary([]) and build_dictionary([b"abc"]) == b"abc"


def test_exponent_meets_its_target(spark):
    sizes = spark.createDataFrame([("a", 900), ("b", 90), ("c", 10)], "mix_key string, tokens long")
    p = np.array([0.9, 0.09, 0.01])
    for target in (0.5, 0.8, 1.0):
        a, z = bisect_exponent(sizes, entropy=target)
        q = p ** a / z
        assert abs(-(q * np.log(q)).sum() - target) < 1e-4 and abs(q.sum() - 1) < 1e-9
    a, _ = bisect_exponent(sizes, repeat_limit=3.0)
    assert abs((0.01 / 0.9) ** (a - 1) - 3) < 1e-3
    assert bisect_exponent(sizes, repeat_limit=1000.0)[0] == 0 and bisect_exponent(sizes.where("false"))[0] == 1


def test_mix_keeps_its_budget(spark):
    rows = [(i, " ".join(["w"] * (1 + i * 7 % 50)), "big" if i % 3 else ("small" if i % 2 else None)) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mix_sources(docs, repeat_limit=1.7, block_tokens=2000)
    got = mixed.groupBy("source").agg(F.sum(F.col("mix_copies") * F.col("mix_tokens")).alias("taken"), F.sum("mix_tokens").alias("own"),
                                      F.first("mix_rate").alias("rate"), F.min("mix_copies").alias("least"), F.max("mix_copies").alias("most")).collect()
    assert {r.source for r in got} == {"big", "small", None}
    for r in got:
        assert abs(r.taken / r.own - r.rate) < 0.03 and r.least >= 1 and r.most <= 2
    assert abs(max(r.rate for r in got) - 1.7) < 1e-3 and min(r.rate for r in got) == 1
    out = take_copies(mixed)
    assert out.columns == docs.columns and out.count() == mixed.agg(F.sum("mix_copies")).first()[0]
    half = mix_sources(docs, entropy=1.0, budget_tokens=20_000, block_tokens=2000)
    assert abs(half.agg(F.sum(F.col("mix_copies") * F.col("mix_tokens"))).first()[0] - 20_000) < 800


def test_mix_beside_clashing_columns(spark):
    docs = spark.createDataFrame([(i, "w " * i, "s", i, "kept") for i in range(1, 40)], "doc_id long, text string, source string, mix_copies long, MIX_Tokens string")
    mixed = mix_sources(docs)
    assert mixed.columns == [*docs.columns, "_mix_tokens", "_mix_weight", "_mix_rate", "_mix_block", "_mix_copies"]
    assert sorted(map(tuple, take_copies(mixed).collect())) == sorted(map(tuple, docs.collect()))


def test_mix_of_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    assert mix_sources(docs).where("mix_copies >= 1").count() == docs.count()
    assert mix_sources(empty(spark)).count() == 0


def test_shards_fit_and_split_only_when_they_must(spark):
    rows = [(i, "x" * (i * 37 % 400)) for i in range(800)] + [(900, "y" * 9000), (None, None), (None, "z")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, bytes string")
    got = shard_documents(df, shard_bytes=4000)
    own = got.collect()
    assert len(own) == len(rows)
    shards = {}
    for r in own:
        assert len(r.shard) == r.depth
        shards.setdefault(r.shard, []).append(r)
    for s, rs in shards.items():
        assert sum(r.bytes for r in rs) == rs[0].shard_bytes and len(rs) == rs[0].shard_rows
        assert rs[0].shard_bytes <= 4000 or len(rs) == 1
        siblings = [r for r in own if s and r.shard.startswith(s[:-1])]
        assert not s or sum(r.bytes for r in siblings) > 4000
    entries = {r.entry: r.shard for r in directory(got).collect()}
    deepest = max(r.depth for r in own)
    assert 0.9 * 2 ** deepest < len(entries) <= 2 ** deepest  # a split may leave one side without a row
    assert all(format(e, f"0{deepest}b").startswith(s) for e, s in entries.items())


def test_rows_of_one_id_split_too(spark):
    df = spark.createDataFrame([(5, "t" * 100)] * 300 + [(6, "u")], "doc_id long, text string").repartition(3)
    got = shard_documents(df, shard_bytes=2000).collect()
    assert len(got) == 301 and max(r.shard_bytes for r in got) <= 2000
    assert shard_documents(empty(spark)).count() == 0 and shard_documents(awkward(spark)).count() == 14


def test_fingerprints_against_plain_sets(spark):
    docs = awkward(spark)
    texts = [(r.doc_id, r["text"] or "") for r in docs.collect()]
    texts.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (d, t) in enumerate(texts):
        n = texts[(i + 1) % len(texts)][1]
        e = edited(t, n)
        like = lambda a, b: 1.0 if not a | b else len(a & b) / len(a | b)
        want.append((str(d), len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(paragraph_set(t), paragraph_set(e)), 9),
                     round(like(paragraph_set(t), paragraph_set(n)), 9)))
    rows = fingerprint_documents(docs).collect()
    got = [(str(r.doc_id), r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in rows]
    assert sorted(got) == sorted(want)
    prints = {}
    for r, (_, t) in zip(sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)), texts):
        prints.setdefault(t, set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert fingerprint_documents(empty(spark)).count() == 0


def test_fingerprints_of_long_texts(spark):
    """Hundreds of paragraphs, so that groups get stuck and are sketched again."""
    rng = np.random.default_rng(6)
    texts = ["\n".join(f"line {x}" for x in rng.integers(0, 4000, n)) for n in (900, 1500, 30, 1)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in fingerprint_documents(docs).collect():
        a, b = paragraph_set(texts[r.doc_id]), paragraph_set(texts[(r.doc_id + 1) % 4])
        assert r.near_next == pytest.approx(len(a & b) / len(a | b))


def cells_of(fingerprint):
    cells = [tuple(int(v, 16 if k else 10) for k, v in enumerate(c.split("."))) if c else (0, 0, 0) for c in fingerprint.split("|")]
    size = ROWS * WIDTH
    return [cells[i:i + size] for i in range(0, len(cells), size)]


def peeled(a, b):
    """Signed digests recovered from two fingerprints alone, or None where peeling gets stuck."""
    a, b = cells_of(a), cells_of(b)
    n = min(len(a), len(b))
    groups = [[[0, 0, 0] for _ in range(ROWS * WIDTH)] for _ in range(n)]
    for sign, own in ((1, a), (-1, b)):
        for g, group in enumerate(own):
            for cell, (k, x, y) in zip(groups[g % n], group):
                cell[:] = cell[0] + sign * k, cell[1] ^ x, cell[2] ^ y
    found = {}
    check = lambda d: (d % CHECK) << 29 ^ d % PRIME
    while pure := [c for g in groups for c in g if abs(c[0]) == 1 and check(c[1]) == c[2]]:
        k, x, y = pure[0]
        found[x] = k
        for j in range(ROWS):
            cell = groups[(x >> GROUP_BIT) % n][j * WIDTH + ((x >> 2 * j) & (WIDTH - 1))]
            cell[:] = cell[0] - k, cell[1] ^ x, cell[2] ^ y
    return found if not any(any(c) for g in groups for c in g) else None


def test_likeness_from_the_fingerprints_alone(spark):
    """Two versions of a text that differ in a few paragraphs: the strings name the digests; their sizes follow the text."""
    rng = np.random.default_rng(8)
    rows, digest = [], lambda t: int(hashlib.md5(t.encode()).hexdigest()[:15], 16)
    for i in range(60):
        old = [f"line {x}" for x in rng.integers(0, 10**6, rng.integers(1, 200))]
        new = [f"new {i} {k}" if rng.random() < 0.05 else t for k, t in enumerate(old)]
        rows += [(2 * i, "\n".join(old)), (2 * i + 1, "\n".join(new))]
    got = {r.doc_id: r for r in fingerprint_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts, solved = dict(rows), 0
    for d in range(0, 120, 2):
        a, b = ({digest(t) for t in texts[k].split("\n")} for k in (d, d + 1))
        groups = len(cells_of(got[d].fingerprint))
        assert groups & (groups - 1) == 0 and len(a) <= 8 * groups and (groups == 1 or len(a) > 4 * groups)
        found = peeled(got[d].fingerprint, got[d + 1].fingerprint)
        if found is not None:
            solved += 1
            assert found == {x: 1 if x in a else -1 for x in a ^ b}
            both = len(a) + len(b)
            assert got[d].near_next == (both - len(found)) / (both + len(found))
    assert solved > 40


def test_recovered_digests(spark):
    """Also of pairs whose stored sketches get stuck, and of sets of very unlike sizes."""
    rng = np.random.default_rng(9)
    pool = [int(x) for x in rng.integers(1, 1 << 60, 5000)]
    rows = []
    for i, (a, b) in enumerate([(0, 0), (1, 0), (0, 5), (8, 8), (9, 300), (3000, 2), (1000, 1000), (40, 40), (17, 16)]):
        rows.append((i, pool[:a], pool[a // 2:a // 2 + b], pool[:a]))
    sets = spark.createDataFrame(rows, "rid long, x array<long>, y array<long>, z array<long>")
    got = {(r.rid, r.pair): r for r in differences(sets, (("x", "y"), ("x", "z")), digests=True).collect()}
    for rid, x, y, z in rows:
        for pair, other in enumerate((y, z)):
            r = got.get((rid, pair))
            ours, theirs = set(x) - set(other), set(other) - set(x)
            assert (set(r.ours), set(r.theirs), r.found) == (ours, theirs, len(ours ^ theirs)) if r else not x and not other


def test_paragraph_sets_keep_every_row(spark):
    assert paragraph_sets(awkward(spark)).select("rid").distinct().count() == awkward(spark).count()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_against_sql(spark, name):
    from oracle_check import compare, connect

    assert compare(spark, connect(SF), name, queries.QUERIES[name], queries.ORACLES[name], SF) is None


def test_pipeline(spark):
    import corpus_pipeline
    from brute import near_duplicate_groups

    from tallyspark.llm.tokens import load, tokenizer_file

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    at, seen = docs, {}
    for name, step in corpus_pipeline.STAGES[:-1]:
        at = step(spark, at, SF).cache()
        assert at.columns == docs.columns
        seen[name] = at.collect()
    assert len(seen["language"]) >= 0.98 * docs.count()
    groups = near_duplicate_groups([(r.doc_id, r.text) for r in seen["language"]], 80)
    kept = {d for d, (_, c) in groups.items() if d == c}
    assert {r.doc_id for r in seen["near_duplicates"]} == kept == {r.doc_id for r in seen["personal_data"]} == {r.doc_id for r in seen["mixing"]}
    rows = corpus_pipeline.run(spark, SF).collect()
    with open(tokenizer_file(), encoding="utf-8") as f:
        whole = load(f.read()).full
    tokens = sum(len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in seen["mixing"])
    assert sum(len(r.ids) // 4 for r in rows) == tokens and {r.doc_id for r in rows} == kept


def test_pipeline_of_awkward_rows(spark):
    import corpus_pipeline

    for docs in (awkward(spark), empty(spark)):
        at = docs
        for _, step in corpus_pipeline.STAGES:
            at = step(spark, at, SF)
        assert (at.count() > 0) == (docs.count() > 0)
