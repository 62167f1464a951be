"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, and a classifier is trained on that.

1. Candidates of every kind come from broad patterns over whole texts.
2. Regex, gazetteer and context labelers vote yes (1), no (-1) or nothing (0) on each candidate.
3. The counts of vote patterns over all documents go into an expectation-maximisation that estimates, per kind, the share of
   true spans and each labeler's reliability, and so the chance that a pattern of votes is a true span. The table is bounded:
   at most three to the number of labelers, per kind.
4. A logistic regression over features of the span and its surroundings is trained on a bounded sample of candidates with
   these chances as soft labels, and has the final say on every candidate.

Spans of the base patterns (``BASE``) are always reported; the method adds candidates that the classifier accepts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import numbered, pick, ship, stage

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "secret")
MAX_TRAIN = 20_000
FEATURES = 256

#: The base patterns in a form that takes one look at each character: an address is found from its "@" outwards, and four
#: numbers from the beginning of the first one.
_HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Broader than the base patterns: what only the votes can tell.
_LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}(?: ?[\[(](?:dot|DOT)[\])] ?[A-Za-z0-9-]{1,63})+")
_LOOSE_PHONE = re.compile(r"(?<![0-9+.-])\(?0?[0-9]{2,4}\)?[ -][0-9]{3}[ -][0-9]{3,5}(?![0-9.-])")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,200}={0,2}(?![A-Za-z0-9_+/=-])")
_DIGIT = re.compile(r"[0-9]")

#: Gazetteers.
_DOMAINS = frozenset("com org net edu gov mil int info biz name io dev app ai co uk de fr es it nl pl se no dk fi ch at be pt eu us ca au jp".split())
_CARD_STARTS = ("4", "51", "52", "53", "54", "55", "34", "37", "36", "38", "6011", "65", "35", "62")
_CONTEXT = {
    "email": frozenset("mail email e-mail contact write correo courriel an mailto from to".split()),
    "ip": frozenset("ip host address server client from adresse login".split()),
    "card": frozenset("card visa mastercard credit debit pay payment karte carte tarjeta amex".split()),
    "phone": frozenset("phone call tel telephone mobile cell fax telefon teléfono téléphone dial".split()),
    "secret": frozenset("token key secret password passwd pwd api apikey api_key bearer auth authorization credential".split()),
}
_AGAINST = frozenset("version isbn issn doi order invoice sha1 sha256 md5 commit checksum digest part no nr serial uuid page".split())
_WORD = re.compile(r"\w+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _byte(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def matches(kind: str, text: str) -> bool:
    """Whether a match of a base pattern also meets the rule of its kind."""
    if kind == "ip":
        return all(_byte(p) for p in text.split("."))
    if kind == "card":
        d = _digits(text)
        return 13 <= len(d) <= 19 and luhn(d)
    if kind == "phone":
        return 9 <= len(_digits(text)) <= 15
    return True


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``, in linear time."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _NAME:
            start -= 1
        host = _HOST.match(text, at + 1) if start < at else None
        # a name never holds an "@", so the next one's characters lie behind this one whether it matched or not
        done = host.end() if host else at + 1
        if host:
            found.append((start, done))
        at = text.find("@", done)
    return found


def candidates(text: str) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of each candidate span of a text; base ones are the leftmost non-overlapping matches."""
    found = []
    if "@" in text:
        found += [("email", *span, True) for span in emails(text)]
    if "[" in text or "(" in text:
        found += [("email", *m.span(), False) for m in _LOOSE_EMAIL.finditer(text)]
    if _DIGIT.search(text):
        found += [("ip", *m.span(), matches("ip", m[0])) for m in _IP.finditer(text)]
        for m in _CARD.finditer(text):
            if 12 <= m.end() - m.start() and (matches("card", m[0]) or 13 <= len(_digits(m[0])) <= 19):
                found.append(("card", *m.span(), matches("card", m[0])))
        if "+" in text:
            found += [("phone", *m.span(), True) for m in _PHONE.finditer(text) if matches("phone", m[0])]
        found += [("phone", *m.span(), False) for m in _LOOSE_PHONE.finditer(text)]
        for m in _SECRET.finditer(text):
            s = m[0]
            if any("0" <= c <= "9" for c in s) and any(c.isalpha() for c in s):
                found.append(("secret", *m.span(), False))
    sure = [(a, b) for _, a, b, base in found if base]
    return [c for c in found if c[3] or all(c[2] <= a or b <= c[1] for a, b in sure)]


LABELERS = ("pattern", "structure", "gazetteer", "context", "against", "shape")


def votes(text: str, kind: str, start: int, end: int, base: bool) -> tuple[int, ...]:
    """The votes of ``LABELERS`` on a candidate."""
    span, d = text[start:end], _digits(text[start:end])
    before = text[max(0, start - 40):start].lower()
    near = set(_WORD.findall(before)[-4:])
    pattern = 1 if base else -1 if kind in ("ip", "card") else 0
    if kind == "email":
        name, _, host = span.partition("@")
        structure = 1 if base and ".." not in host and not name.startswith(".") else 0
        gazetteer = 1 if re.split(r"[^A-Za-z0-9-]+", span.rstrip("])"))[-1].lower() in _DOMAINS else -1
        shape = 1 if any(c.isalpha() for c in name) else -1
    elif kind == "ip":
        parts = span.split(".")
        structure = 1 if all(_byte(p) and (p == "0" or p[0] != "0") for p in parts) else -1
        gazetteer = -1 if span.startswith(("0.", "127.", "255.")) else 0
        shape = 1 if sum(len(p) > 1 for p in parts) >= 2 else -1
    elif kind == "card":
        structure = 1 if luhn(d) else -1
        gazetteer = 1 if d.startswith(_CARD_STARTS) and luhn(d) else -1 if not d.startswith(_CARD_STARTS) else 0
        shape = 1 if len(d) == 16 and len(set(d)) > 3 else -1 if len(set(d)) <= 2 else 0
    elif kind == "phone":
        structure = 1 if 9 <= len(d) <= 15 else -1
        gazetteer = 1 if span.startswith("+") else 0
        shape = 1 if "(" in span or "-" in span else 0
    else:
        hexes = sum(c in "0123456789abcdef" for c in span)
        structure = 1 if len(span) >= 24 else 0
        gazetteer = 1 if span.startswith(("ghp_", "sk_", "pk_", "AKIA", "xox", "eyJ")) else 0
        shape = 1 if hexes == len(span) or (len(set(span)) > 14 and len(d) * 10 > len(span)) else -1
    context = 1 if near & _CONTEXT[kind] or (kind == "secret" and before.rstrip(" \"'").endswith(("=", ":"))) else 0
    against = -1 if near & _AGAINST else 0
    return pattern, structure, gazetteer, context, against, shape


def features(text: str, kind: str, start: int, end: int) -> list[int]:
    """Hashed binary features of a span and its surroundings."""
    span = text[start:end]
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "9", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", span[:80]))))
    names = [f"kind={kind}", f"{kind}:len={min(len(span) // 4, 20)}", f"{kind}:digits={len(_digits(span))}", f"{kind}:shape={shape[:16]}",
             f"{kind}:first={span[:1]}", f"{kind}:luhn={luhn(_digits(span))}", f"{kind}:alphabet={min(len(set(span)), 20)}",
             f"{kind}:left={text[max(0, start - 1):start]}", f"{kind}:right={text[end:end + 1]}"]
    names += [f"{kind}:near={w}" for w in _WORD.findall(text[max(0, start - 40):start].lower())[-3:]]
    return sorted({int.from_bytes(hashlib.blake2b(n.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "big") % FEATURES
                   for n in names})


def reliabilities(patterns: dict[tuple[int, ...], int], rounds: int = 100, prior: float = 0.6) -> dict:
    """EM over counted vote patterns of one kind: share of true spans, P(vote | true), P(vote | false), chance per pattern.

    Starts from labelers that are right in 0.8 of their votes; counts are smoothed by one row per outcome.
    """
    keys = sorted(patterns)
    v = np.array(keys, dtype=int) + 1
    n = np.array([patterns[k] for k in keys], dtype=float)
    labelers = v.shape[1]
    yes = np.tile([0.1, 0.3, 0.6], (labelers, 1))
    no = np.tile([0.6, 0.3, 0.1], (labelers, 1))
    share, chance = prior, np.zeros(len(keys))
    at = np.arange(labelers)
    for _ in range(rounds):
        a = np.log(share) + np.log(yes[at, v]).sum(1)
        b = np.log(1 - share) + np.log(no[at, v]).sum(1)
        fresh = 1 / (1 + np.exp(np.clip(b - a, -500, 500)))
        share = float(((n * fresh).sum() + 3) / (n.sum() + 5))
        for j in range(labelers):
            for k in range(3):
                own = v[:, j] == k
                yes[j, k] = ((n * fresh)[own].sum() + 1 + 2 * (k == 2)) / ((n * fresh).sum() + 5)
                no[j, k] = ((n * (1 - fresh))[own].sum() + 1 + 2 * (k == 0)) / ((n * (1 - fresh)).sum() + 5)
        if np.abs(fresh - chance).max() < 1e-9:
            break
        chance = fresh
    return {"share": share, "yes": yes, "no": no, "chance": dict(zip(keys, chance.tolist()))}


@dataclass
class SpanModel:
    weights: np.ndarray
    bias: float
    labelers: dict[str, dict]

    def accepts(self, text: str, kind: str, start: int, end: int) -> bool:
        return float(self.weights[features(text, kind, start, end)].sum() + self.bias) > 0


def train_classifier(rows: list[tuple[list[int], float]], epochs: int = 8, seed: int = 5) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by stochastic gradient descent."""
    weights, bias = np.zeros(FEATURES), 0.0
    rng = np.random.default_rng(seed)
    for epoch in range(epochs):
        step = 0.3 / (1 + epoch)
        for i in rng.permutation(len(rows)):
            at, target = rows[i]
            miss = 1 / (1 + np.exp(-np.clip(weights[at].sum() + bias, -30, 30))) - target
            weights[at] -= step * miss
            bias -= step * miss * 0.1
    return weights, float(bias)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Votes and features of every candidate, for fitting."""
    for batch in batches:
        kinds, patterns, feats = [], [], []
        for text in batch.column(0):
            text = text.as_py() or ""
            for kind, a, b, base in candidates(text):
                kinds.append(kind)
                patterns.append(votes(text, kind, a, b, base))
                feats.append(features(text, kind, a, b))
        yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(patterns, pa.list_(pa.int32())),
                                          pa.array(feats, pa.list_(pa.int32()))], names=["kind", "votes", "features"])


def fit_span_model(docs: DataFrame, max_train: int = MAX_TRAIN) -> SpanModel:
    """Estimates reliabilities over all candidates of ``docs`` and trains the classifier on at most ``max_train`` of them."""
    ship(docs.sparkSession)
    found = stage(pick(docs, "text").mapInArrow(_scan, "kind string, votes array<int>, features array<int>"), "candidates")
    counts = found.groupBy("kind", "votes").agg(F.count(F.lit(1)).alias("n")).collect()  # at most kinds * 3 ** labelers rows
    labelers = {}
    for kind in KINDS:
        own = {tuple(r.votes): r.n for r in counts if r.kind == kind}
        if own:
            labelers[kind] = reliabilities(own)
    drawn = found.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n"))
    drawn = drawn.orderBy(F.xxhash64("kind", "votes", "features"), "kind", "votes", "features").limit(max_train).collect()
    rows = [(list(r.features), labelers[r.kind]["chance"][tuple(r.votes)]) for r in drawn]
    weights, bias = train_classifier(rows)
    return SpanModel(weights, bias, labelers)


def spans_of(text: str | None, model: SpanModel) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and all spans of a text, each by kind in the order of ``KINDS`` and then by start."""
    text = text or ""
    base, extra = [], []
    for kind, a, b, is_base in candidates(text):
        if is_base:
            base.append((kind, a, b))
        elif model.accepts(text, kind, a, b):
            extra.append((kind, a, b))
    rank = {k: i for i, k in enumerate(KINDS)}
    key = lambda s: (rank[s[0]], s[1], s[2])
    return sorted(base, key=key), sorted({*base, *extra}, key=key)


def _report(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        shape = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
        for batch in batches:
            base, every = [], []
            for text in batch.column(1):
                x, y = spans_of(text.as_py(), model.value)
                base.append(shape(x))
                every.append(shape(y))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span), pa.array(every, span)],
                                             names=["doc_id", "base", "spans"])

    return run


def find_personal_data(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """(doc_id, base, spans) of every row: spans as (kind, start, end) in code points, ``end`` exclusive.

    A null or empty text has no span. Repeated rows come out repeated, an empty table gives no row. Whole texts are read.
    """
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(model or fit_span_model(docs))
    src = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    span = "array<struct<kind: string, start: long, end: long>>"
    return src.mapInArrow(_report(model), f"doc_id long, base {span}, spans {span}")


def redact(text: str | None, model: SpanModel) -> str | None:
    """The text with each span replaced by its kind in angle brackets; of overlapping spans the first wins, then the longest."""
    if not text:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans_of(text, model)[1], key=lambda s: (s[1], -s[2])):
        if b <= at:
            continue
        a = max(a, at)
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]]) if out else text


def _redacted(model, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_col)
            field = batch.schema.field(at)
            texts = pa.array((redact(t.as_py(), model.value) for t in batch.column(at)), field.type)
            yield batch.set_column(at, field, texts)

    return run


def redact_personal_data(docs: DataFrame, model: SpanModel | None = None) -> DataFrame:
    """``docs`` with the personal data of every text replaced by placeholders; ``n_chars``, where there is one, follows."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit_span_model(docs))
    plain, at = numbered(docs)
    plain = plain.mapInArrow(_redacted(shared, at["text"]), plain.schema)
    if "n_chars" in at:
        kind = docs.schema[docs.columns.index("n_chars")].dataType
        plain = plain.withColumn(at["n_chars"], F.char_length(at["text"]).cast(kind))
    return plain.toDF(*docs.columns)
