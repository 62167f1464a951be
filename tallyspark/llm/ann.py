"""Approximate nearest neighbours by a permutation index.

A vector is represented by its ``PREFIX`` nearest pivots in order. The index is cut into blocks of bounded size; a block holds
one inverted file per pivot, with the vectors that have it in their prefix and its place there. A query walks the files of
its own pivots, which gives the footrule distance to every vector of the block, and the nearest ``RERANK`` of them are
compared by inner product on the original vectors. Queries meet the index block by block, in chunks; each pair of a block
and a chunk returns its best only.

Largest inner product is made nearest neighbour by the usual extra component: sqrt(max norm^2 - norm^2) for an indexed
vector, 0 for a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import pick, ship, stage

PIVOTS = 256
PREFIX = 32
RERANK = 0.4
BLOCK_ROWS = 8192
CHUNK_ROWS = 1024
SMALL_BLOCK = 512


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = 0
    for batch in batches:
        ids, rows, vectors, norms = [], [], [], []
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            row += 1
            if i is None or not v.is_valid or not len(v.values) or v.values.null_count:
                continue
            x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all() and x.any():
                ids.append(i)
                rows.append(row)
                vectors.append(x.tobytes())
                norms.append(float((x * x).sum()))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.int64()), pa.array(vectors, pa.binary()),
                                          pa.array(norms, pa.float64())], names=["vec_id", "row", "vector", "norm2"])


def _matrix(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.float64).reshape(len(column), -1)


def nearest_pivots(vectors: np.ndarray, extra: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Numbers of the nearest pivots of each vector, nearest first. The last column of ``pivots`` is the extra component."""
    near = vectors @ pivots[:, :-1].T + extra[:, None] * pivots[:, -1]
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix].astype(np.uint16)


def _represent(pivots, prefix: int, top_norm2: float):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            f = f[f.vector.str.len() == 8 * (pivots.value.shape[1] - 1)]
            if not len(f):
                continue
            x = _matrix(f.vector)
            own = nearest_pivots(x, np.sqrt(np.maximum(0, top_norm2 - f.norm2.to_numpy())), pivots.value, prefix)
            asks = nearest_pivots(x, np.zeros(len(x)), pivots.value, prefix)
            yield pd.DataFrame({"vec_id": f.vec_id, "row": f.row, "vector": f.vector, "own": [r.tobytes() for r in own],
                                "asks": [r.tobytes() for r in asks]})

    return run


class Block:
    """Inverted files of one block: per pivot the rows that have it in their prefix, and how much a shared place counts."""

    def __init__(self, prefixes: np.ndarray, pivots: int):
        n, k = prefixes.shape
        order = np.argsort(prefixes.ravel(), kind="stable")
        self.rows, place = np.divmod(order, k)
        self.gain = (k - place).astype(np.int32)
        self.starts = np.searchsorted(prefixes.ravel()[order], np.arange(pivots + 1))
        self.n, self.k = n, k

    def footrule(self, prefix: np.ndarray) -> np.ndarray:
        """Footrule distance of a prefix to every row, with missing pivots one place after the last: k (k + 1) less twice
        the smaller gain of each shared pivot."""
        shared = np.zeros(self.n, dtype=np.int32)
        for place, p in enumerate(prefix.tolist()):
            own = slice(self.starts[p], self.starts[p + 1])
            shared[self.rows[own]] += np.minimum(self.gain[own], self.k - place)
        return self.k * (self.k + 1) - 2 * shared


def _search(pivots: int, wanted: int, rerank: float):
    def run(index: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        names = ["query_id", "vec_id", "score"]
        if not len(index) or not len(asks):
            return pd.DataFrame({n: pd.Series(dtype="float64" if n == "score" else "int64") for n in names})
        index = index.sort_values(["vec_id", "row"], kind="stable")
        ids, x = index.vec_id.to_numpy(), _matrix(index.vector)
        block = Block(np.frombuffer(b"".join(index.own), dtype=np.uint16).reshape(len(index), -1), pivots)
        size = len(ids) if len(ids) <= SMALL_BLOCK else max(SMALL_BLOCK, wanted + 1, int(rerank * len(ids)))
        out = []
        for query, v, prefix in zip(asks.vec_id, asks.vector, asks.asks):
            far = block.footrule(np.frombuffer(prefix, dtype=np.uint16))
            near = np.arange(len(ids)) if size >= len(ids) else np.sort(np.argpartition(far, size - 1)[:size])
            near = near[ids[near] != query]
            score = (x[near] * np.frombuffer(v, dtype=np.float64)).sum(1)
            best = np.argsort(-score, kind="stable")[:wanted]  # rows are by id, so ties go to the smaller one
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[near[best]], "score": score[best]}))
        return pd.concat(out, ignore_index=True)

    return run


def nearest_neighbours(vectors: DataFrame, every: int = 20, wanted: int = 20, pivots: int = PIVOTS, prefix: int = PREFIX,
                       rerank: float = RERANK) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vector whose id ``every`` divides, its ``wanted`` nearest found.

    Nearest is the largest inner product in double precision, ties to the smaller id; a query is no neighbour of its own id.
    Null ids, null, empty and zero vectors, vectors with null or non-finite components, and vectors of another length than
    the pivots take no part. Fewer candidates than wanted are all returned. Pivots are a sample of ``pivots`` vectors by hash.
    """
    spark = vectors.sparkSession
    ship(spark)
    src = pick(vectors, "vec_id", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    valid = stage(src.mapInArrow(_valid, "vec_id long, row long, vector binary, norm2 double"), "vectors")
    top, n = valid.agg(F.max("norm2"), F.count(F.lit(1))).first()
    sample = valid.orderBy(F.xxhash64("vec_id", "row"), "vec_id", "row").limit(pivots).collect()
    sizes = [len(r.vector) for r in sample]
    length = max(set(sizes), key=lambda s: (sizes.count(s), s)) if sizes else 8
    sample = [r for r in sample if len(r.vector) == length]
    table = _matrix([r.vector for r in sample]) if sample else np.zeros((0, 1))
    extra = np.sqrt(np.maximum(0, (top or 0) - np.array([r.norm2 for r in sample])))
    shared = spark.sparkContext.broadcast(np.column_stack([table, extra]))  # ``pivots`` vectors
    index = valid.mapInPandas(_represent(shared, min(prefix, len(sample)), top or 0.0),
                              "vec_id long, row long, vector binary, own binary, asks binary")
    index = stage(index, "index")
    blocks, chunks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-n // every // CHUNK_ROWS))
    place = F.xxhash64("vec_id", "row")
    left = index.select("vec_id", "row", "vector", "own", F.pmod(place, F.lit(blocks)).alias("block"),
                        F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
    asks = index.where(F.col("vec_id") % every == 0).select(
        "vec_id", "vector", "asks", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"),
        F.pmod(place, F.lit(chunks)).alias("chunk"))
    found = left.groupBy("block", "chunk").cogroup(asks.groupBy("block", "chunk")).applyInPandas(
        _search(max(1, len(sample)), wanted, rerank), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")
