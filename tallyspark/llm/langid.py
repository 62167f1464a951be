"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by SGD in numpy.

A text is lower-cased and cut into words of letters; a word with its end marks gives its subwords of one to four
characters, each hashed to one of ``BUCKETS`` embeddings. The text is the mean of its embeddings, and a linear layer with
softmax gives the language. Probabilities are calibrated by a temperature fitted on training rows held back from SGD;
a text is rejected when its calibrated probability is below that of nearly all held-back rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import numbered, pick, ship
from tallyspark.llm.shingles import mix

BUCKETS = 1 << 15
WIDTH = 16
SIZES = (1, 2, 3, 4)
PER_LABEL = 500
MAX_TRAIN = 10_000
UNKNOWN = "und"

_letter: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Which code points are letters; worked out once per process."""
    global _letter
    if _letter is None:
        _letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _letter


def _blocks(texts: list[str], max_chars: int = 1 << 19) -> Iterator[tuple[int, int]]:
    low = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > max_chars:
            yield low, i
            low, size = i, 0
        size += len(t)
    if low < len(texts):
        yield low, len(texts)


def subwords(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each subword of some texts, the text it belongs to, and which texts have a letter."""
    texts = [t.lower() for t in texts]
    codes = np.frombuffer(" ".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    solid = _letters()[codes]
    owner = np.repeat(np.arange(len(texts) + 1), [*(len(t) + 1 for t in texts), 1])  # a text with the blank before it
    letter_of = np.zeros(len(texts) + 1, dtype=bool)
    letter_of[np.minimum(owner[solid], len(texts))] = True
    shown = np.where(solid, codes, np.uint32(32)).astype(np.uint32)
    buckets, owners = [], []
    h = np.zeros(len(shown), dtype=np.uint32)
    inner = np.zeros(len(shown) + 1, dtype=np.int64)
    np.cumsum(~solid, out=inner[1:])
    for size in range(1, max(SIZES) + 1):
        n = len(shown) - size + 1
        if n <= 0:
            break
        h = (h[:n] * np.uint32(0x01000193)) ^ (shown[size - 1:] * np.uint32(0x9E3779B1))
        if size not in SIZES:
            continue
        if size == 1:
            whole = solid
        elif size == 2:
            whole = solid[:n] | solid[1:]
        else:  # letters, with an end mark on either side at most
            whole = inner[size - 1:n + size - 1] == inner[1:n + 1]
        x = h[whole] + np.uint32(size * 0x85EBCA6B & 0xFFFFFFFF)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        buckets.append((x ^ (x >> np.uint32(13))) & np.uint32(BUCKETS - 1))
        at = np.flatnonzero(whole)  # the place of a letter of the subword tells its text
        at = at if size == 1 else at + (~solid[at] if size == 2 else 1)
        owners.append(owner[at])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), letter_of[:len(texts)]


def profiles(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets of each text and their share of its subwords."""
    out = []
    for low, high in _blocks(texts):
        b, o, _ = subwords(texts[low:high])
        keys, n = np.unique(o * BUCKETS + b, return_counts=True)
        cuts = np.searchsorted(keys // BUCKETS, np.arange(high - low + 1))
        for i in range(high - low):
            own = slice(cuts[i], cuts[i + 1])
            total = n[own].sum()
            out.append(((keys[own] % BUCKETS).astype(np.int32), (n[own] / max(total, 1)).astype(np.float32)))
    return out


@dataclass
class LanguageModel:
    """Languages, the embedding table times the linear layer (one row per bucket), bias, temperature, rejection limit."""

    labels: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0
    losses: list[float] = field(default_factory=list)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability and rejection of each text."""
        names, scores, rejected = [], [], []
        filled = [t or "" for t in texts]
        for low, high in _blocks(filled):
            b, o, has_letter = subwords(filled[low:high])
            n = np.maximum(np.bincount(o, minlength=high - low), 1)
            if self.labels:
                z = np.stack([np.bincount(o, weights=self.table[b, j], minlength=high - low)
                              for j in range(len(self.labels))], axis=1) / n[:, None] + self.bias
                p = _softmax(z / self.temperature)
                best = p.argmax(1)
                top = p[np.arange(len(p)), best]
            else:
                best, top = np.zeros(high - low, int), np.zeros(high - low)
            ok = has_letter & bool(self.labels)
            names += [self.labels[i] if k else UNKNOWN for i, k in zip(best, ok)]
            scores.append(np.where(ok, top, 0.0))
            rejected.append(~ok | (top < self.reject_below))
        if not names:
            return [], np.zeros(0), np.zeros(0, bool)
        return names, np.concatenate(scores), np.concatenate(rejected)


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(examples: list[tuple[np.ndarray, np.ndarray]], labels: list[str], steps: int = 700, rate: float = 0.4,
          batch: int = 64, reject_share: float = 0.0005, seed: int = 11) -> LanguageModel:
    """Fits the model by mini-batch SGD on four fifths of the examples, the temperature and limit on the rest.

    At least ``steps`` batches are drawn, and every example six times.
    """
    names = sorted(set(labels))
    y = np.array([names.index(x) for x in labels], dtype=np.int64)
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    out = rng.normal(0, 0.1, (WIDTH, len(names))).astype(np.float32)
    bias = np.zeros(len(names), dtype=np.float32)
    order = rng.permutation(len(y))
    back, used = order[:len(y) // 5], order[len(y) // 5:]
    losses: list[float] = []
    epochs = max(6, -(-steps // max(1, -(-len(used) // batch))))

    def gather(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts = [examples[i] for i in rows]
        return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]),
                np.repeat(np.arange(len(rows)), [len(p[0]) for p in parts]))

    def hidden(ids: np.ndarray, weight: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
        v = emb[ids] * weight[:, None]
        return np.stack([np.bincount(of, weights=v[:, k], minlength=n) for k in range(WIDTH)], axis=1).astype(np.float32)

    for epoch in range(epochs if len(names) > 1 else 0):
        rng.shuffle(used)
        total, step = 0.0, rate * (1 - epoch / epochs)
        for low in range(0, len(used), batch):
            rows = used[low:low + batch]
            ids, weight, of = gather(rows)
            h = hidden(ids, weight, of, len(rows))
            p = _softmax(h @ out + bias)
            total -= float(np.log(p[np.arange(len(rows)), y[rows]] + 1e-12).sum())
            p[np.arange(len(rows)), y[rows]] -= 1
            back_h = p @ out.T
            out -= step / len(rows) * (h.T @ p)
            bias -= step / len(rows) * p.sum(0)
            # An embedding moves by its share of a text; the factor makes up for how thinly a mean spreads the gradient.
            grad = back_h[of] * weight[:, None]
            uniq, at = np.unique(ids, return_inverse=True)
            moved = np.stack([np.bincount(at, weights=grad[:, k], minlength=len(uniq)) for k in range(WIDTH)], axis=1)
            emb[uniq] -= (step * 40 / len(rows) * moved).astype(np.float32)
        losses.append(total / max(len(used), 1))
    model = LanguageModel(names, (emb @ out).astype(np.float32), bias, losses=losses)
    if len(names) > 1 and len(back):
        ids, weight, of = gather(back)
        z = hidden(ids, weight, of, len(back)) @ out + bias
        grid = np.exp(np.linspace(np.log(0.05), np.log(10), 120))
        loss = [-np.log(_softmax(z / t)[np.arange(len(back)), y[back]] + 1e-12).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        top = _softmax(z / model.temperature).max(1)
        # Never far above plain chance: a short or mixed text stays, one that looks like no language goes.
        model.reject_below = float(min(np.quantile(top, reject_share), 1.4 / len(names)))
    return model


def held_out(doc_id: Column) -> Column:
    """Rows kept out of training: crc32 of the id as text, modulo five, is zero. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Two examples per text: all of it, and one run of a few words at a place drawn from the text's own hash."""
    for batch in batches:
        texts, labels, draws = (batch.column(i).to_pylist() for i in range(3))
        more = []
        for t, d in zip(texts, draws):
            words = t.split()
            n = 3 + (d >> 8) % 12
            at = (d >> 16) % max(1, len(words) - n + 1)
            more.append(" ".join(words[at:at + n]))
        got = profiles(texts) + profiles(more)
        yield pa.RecordBatch.from_arrays(
            [pa.array(labels + labels), pa.array([a.tobytes() for a, _ in got], pa.binary()),
             pa.array([b.tobytes() for _, b in got], pa.binary())], names=["lang", "ids", "weights"])


def fit_language_model(docs: DataFrame, per_label: int = PER_LABEL, max_train: int = MAX_TRAIN) -> LanguageModel:
    """Trains on at most ``per_label`` labelled training documents of a language, ``max_train`` in all, drawn by hash.

    Rows with a null label, a null text or a text without a letter are no examples; held-out rows are never used.
    """
    ship(docs.sparkSession)
    src = pick(docs, "doc_id", "text", "lang").where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull()
                                                     & F.col("text").rlike(r"\p{L}"))
    src = src.select("text", F.col("lang").cast("string").alias("lang"), "doc_id",
                     (F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(7)).bitwiseAND(2**40 - 1)).alias("draw"))
    # Draws below a bound that leaves about twice what is wanted of each frequent language, so that few rows of it meet in
    # one task. The bounds of at most 1,000 languages are a literal; of the others, which are rarer, every row goes on.
    counts = src.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(1000).collect()
    ids = src.select("doc_id", "lang", "draw")
    if counts:
        bounds = F.create_map(*(F.lit(x) for r in counts for x in (r.lang, min(1.0, (2 * per_label + 50) / r.n) * 2.0**40)))
        ids = ids.where(F.col("draw") <= F.coalesce(F.try_element_at(bounds, F.col("lang")), F.lit(2.0**40)))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.col("doc_id").asc_nulls_first()))
    chosen = ids.withColumn("place", place).where(F.col("place") <= per_label)
    chosen = chosen.orderBy("place", "draw", "lang").limit(max_train).select(
        F.col("doc_id").alias("chosen_id"), F.col("lang").alias("chosen_lang"))
    # At most max_train ids, so this side of the join is small by construction.
    picked = src.join(F.broadcast(chosen), src.doc_id.eqNullSafe(F.col("chosen_id")) & (src.lang == F.col("chosen_lang")), "left_semi")
    rows = picked.select("text", "lang", "draw").mapInArrow(_examples, "lang string, ids binary, weights binary").toArrow()
    labels = rows.column("lang").to_pylist()
    ids_, weights = rows.column("ids").to_pylist(), rows.column("weights").to_pylist()
    order = sorted(range(len(labels)), key=lambda i: (labels[i], ids_[i]))  # the same model whatever the partitions
    examples = [(np.frombuffer(ids_[i], np.int32), np.frombuffer(weights[i], np.float32)) for i in order]
    kept = [i for i in range(len(order)) if len(examples[i][0])]
    return train([examples[i] for i in kept], [labels[order[i]] for i in kept])


def _predict(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                names, scores, rejected = model.value.predict(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(scores),
                                                  pa.array(rejected)], names=["doc_id", "lang_pred", "score", "rejected"])

    return run


def identify_language(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """(doc_id, lang_pred, score, rejected) of every row. A null text and one without a letter are ``und`` with score 0
    and rejected. Only the text is read for a prediction. An empty table, or one without labels, gives ``und`` only."""
    spark = docs.sparkSession
    ship(spark)
    model = model or fit_language_model(docs)
    shared = spark.sparkContext.broadcast(model)  # BUCKETS rows of one number per language
    src = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return src.mapInArrow(_predict(shared), "doc_id long, lang_pred string, score double, rejected boolean")


def _accepted(model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_col)
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                rejected = model.value.predict(part.column(at).to_pylist())[2]
                yield part.filter(pa.array(~rejected))

    return run


def keep_identified(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The rows of ``docs`` whose language is recognised, with all their columns."""
    ship(docs.sparkSession)
    model = model or fit_language_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    plain, at = numbered(docs)
    return plain.mapInArrow(_accepted(shared, at["text"]), plain.schema).toDF(*docs.columns)
