"""Hard negatives by Kronecker-packed products.

Vectors are integers, ``floor(scale * x)``. A component of some hundred candidates is biased to be no less than zero and put into
fields of one wide integer; a field is wide enough for a whole biased inner product. Multiplying the wide integer of a
component with the anchor's own biased component, and adding up over the components, leaves one exact biased product in every
field; the biases' share is taken off after unpacking.

Candidates are dealt to blocks of bounded size and anchors to chunks; each pair of a block and a chunk hands on its best only.
A first pass finds the positives, a second one the negatives within the bounds that each positive sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import pick, ship, stage

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90
BLOCK_ROWS = 8192
CHUNK_ROWS = 1024
PACKED = 512
#: Larger components are cut down to this, so that a product of two fits a long.
MOST = 2**31 - 1
_LIMIT = 2**63 - 1


def _integers(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, data = [], []
            for i, v in enumerate(batch.column(3)):
                if not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if np.isfinite(x).all():
                    with np.errstate(over="ignore"):
                        x = np.floor(scale * x)
                    keep.append(i)
                    data.append(np.clip(x, -MOST, MOST).astype("<i4").tobytes())
            own = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c).take(own) for c in range(3)] + [pa.array(data, pa.binary())],
                                             names=["row", "vec_id", "label", "vector"])

    return run


class Packed:
    """Integer vectors of one length as wide integers: one for each component and ``PACKED`` vectors."""

    def __init__(self, vectors: np.ndarray, anchors: np.ndarray):
        self.n, self.size = vectors.shape
        self.bias = max(0, -int(vectors.min(initial=0)))
        self.anchor_bias = max(0, -int(anchors.min(initial=0)))
        largest = (int(vectors.max(initial=0)) + self.bias) * (int(anchors.max(initial=0)) + self.anchor_bias) * self.size
        self.field = next(b for b in (4, 8, 16) if largest < 1 << (8 * b))  # bytes; components of 32 bits never need more
        self.narrow = largest < 1 << 62  # then 64-bit arithmetic is exact all the way
        self.sums = vectors.sum(axis=1, dtype=np.int64)
        self.wide = []
        for low in range(0, self.n, PACKED):
            own = (vectors[low:low + PACKED].astype(np.int64) + self.bias).astype("<u8")
            fields = np.zeros((self.size, len(own), self.field), dtype=np.uint8)
            least = min(8, self.field)
            fields[:, :, :least] = own.T.copy().view(np.uint8).reshape(self.size, len(own), 8)[:, :, :least]
            self.wide.append((len(own), [int.from_bytes(f.tobytes(), "little") for f in fields]))

    def scores(self, anchor: np.ndarray) -> np.ndarray:
        """Exact inner products with every vector; 64-bit integers, or Python's own where those do not suffice."""
        own = [int(a) + self.anchor_bias for a in anchor]
        out = []
        for n, components in self.wide:
            total = 0
            for w, a in zip(components, own):
                if a:
                    total += w * a
            out.append(total.to_bytes(n * self.field, "little"))
        raw = b"".join(out)
        # (x + bias) (a + anchor bias), added up, holds the anchor bias times x and the bias times the biased anchor besides x a
        share = self.bias * sum(own)
        if self.narrow:
            return np.frombuffer(raw, f"<u{self.field}").astype(np.int64) - self.anchor_bias * self.sums - share
        halves = np.frombuffer(raw, "<u8").astype(object)
        if self.field == 16:
            halves = halves[::2] + (halves[1::2] << 64)
        return halves - self.anchor_bias * self.sums.astype(object) - share


def first_places(scores: np.ndarray, among: np.ndarray, wanted: int) -> np.ndarray:
    """The ``wanted`` places of ``among`` with the largest scores, equal ones in their order."""
    if len(among) > wanted and scores.dtype != object:
        least = np.partition(scores[among], len(among) - wanted)[len(among) - wanted]
        among = among[scores[among] >= least]
    return np.array(sorted(among.tolist(), key=lambda i: -scores[i])[:wanted], dtype=np.int64)


def _long(score) -> int:
    return max(-_LIMIT, min(_LIMIT, int(score)))


def _by_length(index: pd.DataFrame, anchors: pd.DataFrame):
    """Vectors and anchors of one length at a time: (candidates by id, their packed form, anchors, their vectors)."""
    index = index.sort_values(["vec_id", "row"], kind="stable")
    for size in sorted(set(anchors.vector.str.len()) & set(index.vector.str.len())):
        own, asks = index[index.vector.str.len() == size], anchors[anchors.vector.str.len() == size]
        read = lambda column: np.frombuffer(b"".join(column), "<i4").reshape(len(column), size // 4)
        x, a = read(own.vector), read(asks.vector)
        yield own.row.to_numpy(), own.vec_id.to_numpy(), own.label.to_numpy(), Packed(x, a), asks, a


def _positives(wanted: int):
    def run(index: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rows, ids, labels, packed, asks, a in _by_length(index, anchors):
            for row, vec_id, label, vector in zip(asks.row, asks.vec_id, asks.label, a):
                scores = packed.scores(vector)
                for i in first_places(scores, np.flatnonzero((labels == label) & (ids != vec_id)), wanted):
                    out.append((row, rows[i], ids[i], _long(scores[i])))
        return pd.DataFrame(out, columns=["anchor", "row", "vec_id", "score"]).astype("int64")

    return run


def _negatives(wanted: int, low: int, high: int):
    def run(index: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        out = []
        for rows, ids, labels, packed, asks, a in _by_length(index, anchors):
            for row, vec_id, label, vector, positives in zip(asks.row, asks.vec_id, asks.label, a, asks.positives):
                scores = packed.scores(vector)
                other = np.flatnonzero((labels != label) & (ids != vec_id))
                for p in positives:
                    score = int(p["score"])
                    # 100 * negative lies between low * positive and high * positive, in whole numbers
                    least, most = -(-low * score // 100), high * score // 100
                    within = other[((scores[other] >= least) & (scores[other] <= most)).astype(bool)]
                    for i in first_places(scores, within, wanted):
                        out.append((row, vec_id, p["row"], p["vec_id"], score, rows[i], ids[i], _long(scores[i])))
        return pd.DataFrame(out, columns=["anchor", "anchor_id", "positive", "positive_id", "positive_score", "row", "negative_id",
                                          "negative_score"]).astype("int64")

    return run


def mine_negatives(vectors: DataFrame, label: Column | None = None, every: int = 100, positives: int = POSITIVES,
                   negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: float = SCALE,
                   block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    Anchors are the rows whose ``vec_id`` is divisible by ``every``. Scores are inner products of ``floor(scale * x)``, larger
    ones first, ties to the smaller vec_id. Positives are an anchor's first rows of its label, negatives the first rows of
    another label with ``low * positive_score <= 100 * negative_score <= high * positive_score``. ``label`` may reckon the
    label from the columns vec_id and label.

    Rows with a null vec_id, label, vector or component, or a component that is not finite, take no part; vectors are compared
    with those of their own length. Rows of the anchor's own vec_id are not its candidates. Repeated rows are rows of their
    own, as candidates and as anchors. Integers beyond 32 bits are cut to them, scores beyond a long to a long's ends. Other
    columns do not matter. An empty table, or one without anchors, gives no rows.
    """
    spark = vectors.sparkSession
    ship(spark)
    src = pick(vectors, "vec_id", "label", "embedding").withColumn("vec_id", F.col("vec_id").cast("long"))
    src = src.withColumn("label", (F.col("label") if label is None else label).cast("long")).where("vec_id is not null and label is not null")
    src = src.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding")
    index = stage(src.mapInArrow(_integers(scale), "row long, vec_id long, label long, vector binary"), "integers")
    asked = F.col("vec_id") % every == 0
    n, n_anchors = index.agg(F.count(F.lit(1)), F.count_if(asked)).first()
    blocks, chunks = max(1, -(-n // block_rows)), max(1, -(-n_anchors // CHUNK_ROWS))

    def each(count: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    place = F.xxhash64("row")
    left = index.withColumn("block", F.pmod(place, F.lit(blocks)).cast("int")).withColumn("chunk", each(chunks))
    anchors = index.where(asked).withColumn("chunk", F.pmod(place, F.lit(chunks)).cast("int"))

    def met(asks: DataFrame, work, schema: str) -> DataFrame:
        asks = asks.withColumn("block", each(blocks))
        return left.groupBy("block", "chunk").cogroup(asks.groupBy("block", "chunk")).applyInPandas(work, schema)

    found = met(anchors, _positives(positives), "anchor long, row long, vec_id long, score long")
    place_of = F.row_number().over(Window.partitionBy("anchor").orderBy(F.col("score").desc(), "vec_id", "row"))
    own = found.withColumn("place", place_of).where(F.col("place") <= positives).groupBy("anchor").agg(
        F.collect_list(F.struct("row", "vec_id", "score")).alias("positives"))
    asks = stage(anchors.join(own.withColumnRenamed("anchor", "row"), "row"), "anchors")
    found = met(asks, _negatives(negatives, low, high),
                "anchor long, anchor_id long, positive long, positive_id long, positive_score long, row long, negative_id long, "
                "negative_score long")
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.col("negative_score").desc(), "negative_id", "row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= negatives).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
