"""Personal data, language and licences on small texts."""

import hashlib
import random
import re
import time
from collections import Counter

import numpy as np
import pytest
from brute import awkward, empty

from tallyspark.llm import queries
from tallyspark.llm.langid import BUCKETS, fit_language_model, held_out, identify_language, keep_identified, profiles, train
from tallyspark.llm.licenses import TEMPLATES, Templates, bigrams, scan, scan_licenses, words
from tallyspark.llm.pii import _IP, candidates, emails, fit_span_model, find_personal_data, luhn, redact_personal_data, reliabilities

SF = "/root/testdata/sf0.001"
PRIVATE = ["write to ann.lee@mail.example.com or b@c or x@y.z now", "host 10.0.0.255 and 10.0.0.256 and 1.2.3.4.5",
           "card 4111 1111 1111 1111 or 4111-1111-1111-1112 or 5500000000000004", "call +1 (555) 123-4567 or +12 or +123456789012345678",
           'token = "2abc3ff2ca8fb1e4c565a0eb63815530a948bdde" end', "é😀 ann@b.co é", "", None, "5" * 40, "+1.+2.+3 (((", "a@b.c@d.e"]


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"\D", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"\D", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_linear_patterns_equal_the_base_patterns():
    """Leftmost non-overlapping matches of the contract's patterns, on text full of near misses."""
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    rng = random.Random(7)
    for _ in range(20_000):
        text = "".join(rng.choice("a1.@-_ é@.") for _ in range(rng.randint(0, 24)))
        assert emails(text) == [m.span() for m in email.finditer(text)]
        text = "".join(rng.choice("012.. x") for _ in range(rng.randint(0, 30)))
        assert [m.span() for m in _IP.finditer(text)] == [m.span() for m in ip.finditer(text)]


@pytest.mark.parametrize("text", ["1" * 10**6, "a" * 10**6 + "@", "a@" * 500_000, "a" * 500_000 + "@b" + "c" * 500_000, "1." * 500_000, "+1 " * 300_000,
                                  "x" * 10**6 + " a@b.cd"])
def test_a_megabyte_without_blanks(text):
    began = time.perf_counter()
    found = candidates(text)
    assert time.perf_counter() - began < 10
    assert [c for c in found if c[0] == "email"] == ([("email", 10**6 + 1, 10**6 + 7, True)] if text.endswith("cd") else [])


def test_base_spans_stay_and_are_exact(spark):
    docs = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string")
    for r in find_personal_data(docs).collect():
        want = base_spans(PRIVATE[r.doc_id] or "")
        assert [tuple(s) for s in r.base] == want
        assert {tuple(s) for s in r.spans} >= set(want)


def test_query_on_a_whole_table(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op2_weak_supervision_pii"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = base_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")]
        assert set(filter(None, r.spans.split(","))) >= {f"{k}:{a}:{b}" for k, a, b in want}


def test_awkward_and_empty_tables(spark):
    docs = awkward(spark)
    assert find_personal_data(docs).count() == docs.count()
    assert find_personal_data(empty(spark)).count() == 0
    out = redact_personal_data(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert sorted(map(str, (r["text"] for r in out.collect()))) == sorted(map(str, (r["text"] for r in docs.collect())))


def test_redaction(spark):
    docs = spark.createDataFrame(list(enumerate(PRIVATE)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in redact_personal_data(docs, fit_span_model(docs)).collect()}
    assert got[0].startswith("write to <EMAIL> or b@c") and got[5] == "é😀 <EMAIL> é" and got[7] is None


def test_reliabilities_find_the_good_labeler():
    """Two labelers that agree with a hidden truth and one that votes by chance."""
    rng = np.random.default_rng(0)
    counts = {}
    for _ in range(4000):
        truth = rng.random() < 0.3
        v = tuple(int(x) for x in (1 if (rng.random() < 0.95) == truth else -1, 1 if (rng.random() < 0.9) == truth else -1, rng.choice([-1, 1])))
        counts[v] = counts.get(v, 0) + 1
    got = reliabilities(counts)
    assert abs(got["share"] - 0.3) < 0.08
    assert got["yes"][0, 2] > 0.8 and abs(got["yes"][2, 2] - 0.5) < 0.1
    assert got["chance"][(1, 1, 1)] > 0.9 > 0.1 > got["chance"][(-1, -1, -1)]


def test_language_of_held_out_documents(spark):
    rows = queries.QUERIES["op5_language_id"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    out = [r for r in rows if r.held_out]
    assert len(rows) == 1000 and 100 < len(out) < 300
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 for r in rows) and sum(r.rejected for r in rows) < 10


def test_language_of_awkward_rows(spark):
    docs = awkward(spark)
    model = fit_language_model(docs)
    rows = {r.doc_id: r for r in identify_language(docs, model).collect()}
    assert {d for d, r in rows.items() if r.lang_pred == "und"} == {4, 5, 6, 10}
    assert all(rows[d].rejected and rows[d].score == 0 for d in (4, 5, 6, 10))
    kept = keep_identified(docs, model)
    assert kept.columns == docs.columns and {4, 5, 6, 10}.isdisjoint(r.doc_id for r in kept.collect())
    assert identify_language(empty(spark)).count() == 0 and keep_identified(empty(spark)).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    from pyspark.sql import functions as F

    spoiled = docs.withColumn("lang", F.when(held_out(F.col("doc_id")), F.lit("xx")).otherwise(F.col("lang")))
    a, b = fit_language_model(docs), fit_language_model(spoiled)
    assert a.labels == b.labels and np.array_equal(a.table, b.table)


def test_subwords_do_not_cross_texts():
    alone = profiles(["ab cd"])[0]
    among = profiles(["zz zz", "ab cd", "q"])[1]
    assert np.array_equal(alone[0], among[0]) and np.array_equal(alone[1], among[1])
    assert len(profiles(["", "1 2"])[0][0]) == 0 and alone[0].max() < BUCKETS


def test_training_on_one_label():
    model = train(profiles(["some text", "more text"]), ["en", "en"])
    assert model.predict(["text", None, "12"])[0] == ["en", "und", "und"]


def test_templates_match_themselves():
    known = Templates()
    for name, text in TEMPLATES:
        found = scan(text.upper(), known)
        assert [(n, d, first, n_words) for n, d, first, n_words, *_ in found] == [(name, 1.0, 0, len(words(text)))]


def brute_licenses(text, templates, threshold):
    """Every run of every template, without pruning but for the longest a run may be."""
    own = words(text)
    pairs, ranked = list(zip(own, own[1:])), []
    for number, (name, body) in enumerate(templates):
        goal = bigrams(words(body))
        for first in (i for i, p in enumerate(pairs) if p in goal):
            runs = []
            for last in range(first, min(len(pairs), first + int(goal.total() * (2 - threshold) / threshold + 1e-9))):
                shared, every = (Counter(pairs[first:last + 1]) & goal).total(), last - first + 1 + goal.total()
                dice = 2 * shared / every
                if pairs[last] in goal and dice >= threshold:
                    runs.append((-dice, -last, every - 4 * shared))
            if runs:
                less, back, loss = min(runs)
                ranked.append((loss, less, first, -back, name, number))
    ranked.sort()
    kept = []
    for r in ranked:
        if not any(o[2] <= r[3] + 1 and r[2] <= o[3] + 1 for o in kept):
            kept.append(r)
    return sorted((r[2], r[3] - r[2] + 2, r[4], -r[1]) for r in kept)


def test_runs_equal_brute_force():
    rng = random.Random(2)
    some = [TEMPLATES[i] for i in (0, 1, 2, 5, 6, 8, 9, 12, 13, 18, 22, 29, 30, 31)]
    for threshold in (0.6, 0.8):
        known = Templates(some, threshold)
        for _ in range(20):
            parts = []
            for _ in range(rng.randrange(1, 6)):
                own = words(rng.choice(some)[1])
                start = rng.randrange(max(1, len(own) // 3))
                own = own[start:len(own) - rng.randrange(max(1, len(own) // 3))]
                parts += [w if rng.random() > 0.05 else "other" for w in own] + rng.choices(("the", "license", "of", "under", "version"), k=rng.randrange(4))
            text = "".join(w + rng.choice((" ", "\n", ", ", ".  ")) for w in parts)
            got = sorted((first, n, name, dice) for name, dice, first, n, _, _ in scan(text, known))
            assert got == brute_licenses(text, some, threshold)


@pytest.mark.parametrize("text,want", [
    ("one two\nLicensed under the MIT licence!\nend", "Licensed under the MIT licence"),
    ("Some words; this is Licensed under\nthe MIT License. And more words here", "Licensed under\nthe MIT License"),
    ("é\u2028Licensed under\n\nthe MIT License.\n\nnext part of it", "Licensed under\n\nthe MIT License")])
def test_notices_across_lines(text, want):
    [(name, dice, first, n_words, start, end)] = scan(text, Templates())
    assert (name, dice, n_words, text[start:end]) == ("MIT", 1.0, 5, want) and words(text[:start]) == words(text)[:first]


def test_licences_that_differ_by_a_clause():
    known, whole = Templates(), {name: text for name, text in TEMPLATES}
    around = "Copyright 2020 by some people\n{}\nint main of the program and use in source\n"
    for name in ("BSD-2-Clause", "BSD-3-Clause", "ISC", "0BSD", "GPL-2.0-or-later", "GPL-3.0-or-later", "LGPL-2.1-or-later",
                 "AGPL-3.0-or-later", "CC-BY-4.0", "CC-BY-SA-4.0", "Zlib", "Unlicense", "Apache-2.0"):
        wrapped = re.sub("(.{60}[^ ]*) ", "\\1\n * ", whole[name])
        assert [n for n, *_ in scan(around.format(wrapped), known)] == [name]
    both = around.format(whole["BSD-2-Clause"]) + around.format(whole["BSD-3-Clause"]) + around.format(whole["BSD-2-Clause"])
    assert [n for n, *_ in scan(both, known)] == ["BSD-2-Clause", "BSD-3-Clause", "BSD-2-Clause"]
    changed = re.sub("(DISCLAIMED|EXEMPLARY|distribution)", "other word", whole["BSD-3-Clause"])
    assert [n for n, *_ in scan(around.format(changed), known)] == ["BSD-3-Clause"]
    assert scan("the use of the software and the terms of the public license under which the work is free " * 50, known) == []


def test_long_text_of_notices():
    text = "Licensed under the MIT License. some words between " * 20_000 + "of the license under the " * 20_000
    begin = time.time()
    assert len(scan(text, Templates())) == 20_000 and time.time() - begin < 20


def test_licenses_of_awkward_rows(spark):
    assert scan_licenses(awkward(spark)).count() == 0 and scan_licenses(empty(spark)).count() == 0
