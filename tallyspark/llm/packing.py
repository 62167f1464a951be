"""Lexical retrieval packing: a BM25 inverted index per shard finds unused neighbours of a seed to fill its window.

Terms are token ids, so the document frequencies of the whole corpus are a table bounded by the vocabulary. Documents are
dealt to shards of about ``SHARD_TOKENS`` tokens. A shard holds its own inverted index and is packed in one task: the first
unused document opens a window, its best unused neighbours follow, and what does not fit any more opens the next window
and is its seed. Only the last window of a shard can be short.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import pick, ship, stage
from tallyspark.llm.tokens import load, tokenizer_file

WINDOW = 2048
SHARD_TOKENS = 1_000_000
K1, B = 1.2, 0.75


def _tokenize(definition, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(definition.value)
        gc.disable()  # nothing here is cyclic, and the collector would walk the cache of words again and again
        end = np.array([end_id], dtype=tok.dtype).tobytes()
        row = 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                ids = [x + end for x in tok.encode(part.column(1).to_pylist())]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(ids, pa.binary()),
                     pa.array([len(x) // tok.dtype.itemsize for x in ids], pa.int64()),
                     pa.array(range(row, row + len(ids)), pa.int64())],
                    names=["doc_id", "ids", "doc_tokens", "row"])
                row += len(ids)
        gc.enable()

    return run


def _terms(ids: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and how often each occurs, without sorting. ``place`` is scratch space, one number per id."""
    at = np.arange(len(ids))
    place[ids] = at
    last = place[ids]  # where the same id stands last
    mine = last == at
    return ids[mine], np.bincount(last, minlength=len(ids))[mine]


def _frequencies(dtype: str, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, place = np.zeros(vocabulary, dtype=np.int64), np.zeros(vocabulary, dtype=np.int64)
        for batch in batches:
            for ids in batch.column(0):
                count[_terms(np.frombuffer(ids.as_buffer(), dtype=dtype), place)[0]] += 1
        at = np.flatnonzero(count)
        for low in range(0, len(at), 10_000):
            own = at[low:low + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own])], names=["term", "n"])

    return run


class ShardIndex:
    """BM25 postings of the documents of one shard, with the term weights of the whole corpus."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.of_doc, terms, owner, weight = [], [], [], []
        place = np.zeros(len(idf), dtype=np.int64)
        for i, ids in enumerate(docs):
            t, tf = _terms(ids, place)
            useful = idf[t] > 0
            t, tf = t[useful].astype(np.int64), tf[useful]
            w = idf[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * len(ids) / mean_length))
            self.of_doc.append(t)
            terms.append(t)
            owner.append(np.full(len(t), i, dtype=np.int32))
            weight.append(w)
        terms = np.concatenate(terms)
        order = np.argsort(terms, kind="stable")
        self.owner, self.weight = np.concatenate(owner)[order], np.concatenate(weight)[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(idf) + 1))
        self.n = len(docs)

    def scores(self, i: int) -> np.ndarray:
        """BM25 of every document of the shard for all terms of document ``i``."""
        t = self.of_doc[i]
        first, size = self.starts[t], self.starts[t + 1] - self.starts[t]
        at = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
        return np.bincount(self.owner[at], weights=self.weight[at], minlength=self.n)


def _best_first(scores: np.ndarray, few: int = 24) -> Iterator[int]:
    """Places by falling score, equal ones in order; the first few without sorting them all."""
    if len(scores) > 4 * few:
        limit = np.partition(scores, len(scores) - few)[len(scores) - few]
        first = np.flatnonzero(scores > limit)
        yield from first[np.argsort(-scores[first], kind="stable")].tolist()
        rest = np.flatnonzero(scores <= limit)
    else:
        rest = np.arange(len(scores))
    yield from rest[np.argsort(-scores[rest], kind="stable")].tolist()


def fill_windows(names: list, docs: list[np.ndarray], index: ShardIndex, window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that fill windows one after the other.

    Two documents of one id do not share a window while others are left.
    """
    used = np.zeros(len(docs), dtype=bool)
    sequence, room, upcoming = 0, window, 0
    inside: list[int] = []

    def place(i: int) -> Iterator[tuple[int, int, int, int, int]]:
        nonlocal sequence, room, inside
        used[i] = True
        start, size = 0, len(docs[i])
        while start < size:
            take = min(room, size - start)
            yield i, start, take, sequence, window - room
            start, room = start + take, room - take
            inside.append(i)
            if not room:
                sequence, room, inside = sequence + 1, window, []

    while True:
        while upcoming < len(docs) and used[upcoming]:
            upcoming += 1
        if upcoming == len(docs):
            return
        if not inside:
            yield from place(upcoming)
            continue
        ranked = index.scores(inside[0])
        ranked[used] = -1
        at, placed = sequence, False
        for j in _best_first(ranked):
            if ranked[j] <= 0 or sequence != at:
                break
            if any(names[j] == names[k] for k in inside):
                continue
            placed = True
            yield from place(j)
        if not placed or sequence == at:
            rest = np.flatnonzero(~used)
            if len(rest):
                other = [j for j in rest[:64].tolist() if all(names[j] != names[k] for k in inside)]
                yield from place(other[0] if other else int(rest[0]))


def _pack(definition_dtype: str, idf, mean_length: float, window: int):
    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["doc_id", "row"], kind="stable", na_position="first")
        docs = [np.frombuffer(x, dtype=definition_dtype) for x in f.ids]
        names = [None if pd.isna(d) else int(d) for d in f.doc_id]
        base = int(f.shard.iloc[0]) << 32
        index = ShardIndex(docs, idf.value, mean_length)
        rows = [(names[i], start, len(docs[i]), base + seq, offset, docs[i][start:start + length].astype("<u4").tobytes())
                for i, start, length, seq, offset in fill_windows(names, docs, index, window)]
        out = pd.DataFrame(rows, columns=["doc_id", "start", "doc_tokens", "sequence_id", "offset", "ids"])
        return out.astype({"doc_id": "Int64"})

    return run


def pack_documents(docs: DataFrame, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS, end_id: int = 1,
                   tokenizer_path: str | None = None) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` tokens: (doc_id, start, doc_tokens, sequence_id, offset, ids).

    A document is its token ids and then ``end_id``; a null or empty text is ``end_id`` alone. ``ids`` holds the piece's ids
    as little-endian unsigned 32-bit integers. Each id of each row lies in exactly one piece; repeated rows, also those of
    one doc_id, and rows with a null doc_id are packed one by one. An empty table gives no piece.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path or tokenizer_file(), encoding="utf-8") as f:
        text = f.read()
    tok = load(text)
    definition = spark.sparkContext.broadcast(text)  # as large as the tokenizer file
    src = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    tokens = stage(src.mapInArrow(_tokenize(definition, end_id), "doc_id long, ids binary, doc_tokens long, row long"), "tokens")
    n, total = tokens.agg(F.count(F.lit(1)), F.sum("doc_tokens")).first()
    total, vocabulary = total or 0, len(tok.ends)
    counts = tokens.select("ids").mapInArrow(_frequencies(tok.dtype.str, vocabulary), "term int, n long")
    df = np.zeros(vocabulary)
    for term, k in counts.groupBy("term").agg(F.sum("n")).collect():  # bounded by the vocabulary
        df[term] = k
    idf = np.maximum(0, np.log((n - df + 0.5) / (df + 0.5)))
    idf[df == 0] = 0
    idf = spark.sparkContext.broadcast(idf)
    shards = max(1, -(-total // shard_tokens))
    dealt = tokens.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(
        _pack(tok.dtype.str, idf, total / max(n, 1), window),
        "doc_id long, start long, doc_tokens long, sequence_id long, offset long, ids binary")
