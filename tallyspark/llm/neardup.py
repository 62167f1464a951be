"""MinHash near-duplicate groups through an LSH forest.

A document is the set of its five-word shingles. Each distinct set gets a signature of 128 MinHash values. A tree of the
forest is one order of these values: sets sorted by the reordered signature stand next to those with the longest common
prefix. A region of a tree is the run of sets that share the first ``DEPTH`` values. In a region of up to ``REGION`` sets all
pairs whose signatures agree well are compared on the full shingle sets. Larger regions that share a set form a crowd. All
pairs of a crowd whose sizes allow the limit are compared on full sets, without a look at the signatures: a crowd is cut into
blocks by size and hash, and each pair of blocks is a task's worth of work.

A link is missed only when its sets meet in no tree (at 0.85 with probability 5e-9, at 0.80 6e-7) or, in a small region, when
their signatures agree by ``SLACK`` less than the sets (1.4e-8 and 8e-8). A component is lost only when each of its chains of
links is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import components, numbered, pick, ship, stage
from tallyspark.llm.shingles import mix, shingle_sets, slices
from tallyspark.llm.tokens import forget

VALUES = 128
TREES = 20
DEPTH = 3
REGION = 128
SLACK = 0.2
#: Sets and shingles that a block of a crowd holds, about.
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20
#: Shingles of a region in at most so many sets are counted pair by pair, the others as columns of a matrix.
RARE = 16

_rng = np.random.default_rng(3)
_MULTIPLIERS = _rng.integers(1, 2**32, VALUES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ORDERS = np.stack([_rng.permutation(VALUES) for _ in range(TREES)])


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash values (16 bits each) of non-empty shingle sets."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *(len(s) for s in sets[:-1])])
    low = (flat >> np.uint64(32)).astype(np.uint32)
    high = flat.astype(np.uint32)
    out = np.empty((len(sets), VALUES), dtype=np.uint16)
    for j, m in enumerate(_MULTIPLIERS):
        v = np.minimum.reduceat((low if j % 2 else high) * m, first)
        out[:, j] = mix(v.astype(np.uint64) + np.uint64(j)).astype(np.uint16)
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forget()  # this worker may have packed before
    for batch in batches:
        texts, ids = batch.column(1), batch.column(0)
        for a, b in slices(texts):
            sets = shingle_sets(texts.slice(a, b - a))
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            full = [s for s in sets if len(s)]
            sig = iter(signatures(full) if full else [])
            keys = [(int(s.sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0x5BF0_3635)).sum(dtype=np.uint64))) if len(s) else (0, 0)
                    for s in sets]
            two = np.array(keys, dtype=np.uint64).view(np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(a, b - a), pa.array(sizes), pa.array(two[:, 0]), pa.array(two[:, 1]),
                 pa.array([next(sig).tobytes() if len(s) else None for s in sets], pa.binary())],
                names=["doc_id", "n_shingles", "k1", "k2", "sig"])


def _tree_keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (doc_id, tree, key) of each set: the hash of its prefix in each tree."""
    for f in frames:
        if not len(f):
            continue
        sig = np.frombuffer(b"".join(f.sig), dtype=np.uint16).reshape(len(f), VALUES)
        for t in range(TREES):
            h = np.full(len(f), mix(np.array([t + 1], dtype=np.uint64))[0])
            for i in range(DEPTH):
                h = mix(h ^ (sig[:, _ORDERS[t, i]].astype(np.uint64) + np.uint64(i << 20)))
            yield pd.DataFrame({"doc_id": f.doc_id, "tree": np.int16(t), "key": h.view(np.int64)})


def _regions(sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Small regions (doc_id, tree, region) of two sets or more; and the larger ones as (doc_id, first), the smallest member."""
    keys = stage(sigs.mapInPandas(_tree_keys, "doc_id long, tree smallint, key long"), "keys")
    counts = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1")
    shared = stage(keys.join(counts, "key"), "regions")
    small = shared.where(F.col("n") <= REGION).select("doc_id", "tree", F.col("key").alias("region"))
    return small, shared.where(F.col("n") > REGION).select("doc_id", "first").distinct()


def _block_pairs(reps: DataFrame, crowded: DataFrame, limit: float) -> DataFrame:
    """(doc_id, region): every two sets of a crowd whose sizes allow ``limit`` have a region in common.

    Sizes fall into classes, each ``1 / limit`` times the one before, so such sets are in one class or in neighbouring ones.
    A class of a crowd is cut into blocks by hash; a region is a pair of blocks, or a block alone in its class.
    """
    crowds = components(crowded.select(F.col("doc_id").alias("a"), F.col("first").alias("b")))
    step = F.floor(F.log(F.col("n_shingles").cast("double")) / F.lit(-float(np.log(limit - 1e-9)))).cast("long")
    sets = stage(reps.join(crowds, F.col("node") == F.col("doc_id")).select(
        "doc_id", F.col("component").alias("crowd"), "n_shingles", step.alias("step")), "crowds")
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)), F.ceil(F.sum("n_shingles") / F.lit(BLOCK_SHINGLES)))
    blocks = stage(sets.groupBy("crowd", "step").agg(parts.cast("long").alias("blocks")), "blocks")

    def near(by: int, name: str) -> DataFrame:
        return blocks.select("crowd", (F.col("step") - by).alias("step"), F.col("blocks").alias(name))

    every = blocks.join(near(1, "above"), ["crowd", "step"], "left").join(near(-1, "below"), ["crowd", "step"], "left")
    zero, own = F.lit(0).cast("long"), F.pmod(F.xxhash64("doc_id"), F.col("blocks"))

    def pairs(n: str, pair) -> Column:
        return F.when(F.coalesce(F.col(n), zero) > 0, F.transform(F.sequence(zero, F.col(n) - 1), pair)).otherwise(F.array())

    def name(low: Column, i: Column, high: Column, j: Column) -> Column:
        return F.xxhash64("crowd", low, i, high, j)

    at = F.col("step")
    same = pairs("blocks", lambda j: F.when((F.col("blocks") == 1) | (j != F.col("own")), name(
        at, F.least(F.col("own"), j), at, F.greatest(F.col("own"), j))))
    regions = F.concat(F.filter(same, lambda r: r.isNotNull()), pairs("above", lambda j: name(at, F.col("own"), at + 1, j)),
                       pairs("below", lambda j: name(at - 1, j, at, F.col("own"))))
    # At most one row of ``every`` for each REGION sets and size class.
    placed = sets.join(F.broadcast(every), ["crowd", "step"]).withColumn("own", own)
    return placed.select("doc_id", F.explode(regions).alias("region"))


def _likely(sig: np.ndarray, sizes: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a region whose sizes allow ``limit`` and whose signatures agree in at least ``limit - SLACK``."""
    left, right = [], []
    for i in range(len(sig) - 1):
        near = np.minimum(sizes[i], sizes[i + 1:]) >= (limit - 1e-9) * np.maximum(sizes[i], sizes[i + 1:])
        at = np.flatnonzero(near) + i + 1
        if len(at):
            at = at[(sig[at] == sig[i]).mean(1) >= limit - SLACK]
            left.append(np.full(len(at), i))
            right.append(at)
    if not left:
        return np.zeros(0, int), np.zeros(0, int)
    return np.concatenate(left), np.concatenate(right)


def _runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist())


def _by_run(work):
    """``work(frame of whole regions)`` over partitions sorted by region; a region may span batches."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for f in frames:
            if not len(f):
                continue
            last = f.region.iloc[-1]
            open_at = int(np.searchsorted(f.region.to_numpy(), last))
            if held and (open_at > 0 or held[-1].region.iloc[-1] != last):
                whole = pd.concat([*held, f.iloc[:open_at]], ignore_index=True)
                held = []
                yield from work(whole)
            elif open_at:
                yield from work(f.iloc[:open_at].reset_index(drop=True))
            held.append(f.iloc[open_at:])
        if held:
            yield from work(pd.concat(held, ignore_index=True))

    return run


def _meet(limit: float):
    """Who has a likely partner in this region that it has not met in an earlier tree: rows (doc_id, region)."""

    def work(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        sig = np.frombuffer(b"".join(f.sig), dtype=np.uint16).reshape(len(f), VALUES)
        sizes, trees = f.n_shingles.to_numpy(), f.tree.to_numpy()
        all_regions = f.regions.to_numpy()
        hit = np.zeros(len(f), dtype=bool)
        for a, b in _runs(f.region.to_numpy()):
            if b - a < 2:
                continue
            left, right = _likely(sig[a:b], sizes[a:b], limit)
            if not len(left):
                continue
            t = int(trees[a])
            if t:
                own = np.stack([np.frombuffer(r, dtype=np.int64)[:t] for r in all_regions[a:b]])
                first = ~((own[left] == own[right]) & (own[left] != 0)).any(1)
                left, right = left[first], right[first]
            hit[a + left] = True
            hit[a + right] = True
        if hit.any():
            yield f.loc[hit, ["doc_id", "region"]]

    return _by_run(work)


def _sets_by_region(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Full shingle sets of documents, once per region in which they have a likely partner."""
    for batch in batches:
        for a, b in slices(batch.column(1), 2 << 20):
            sets = shingle_sets(batch.column(1).slice(a, b - a))
            regions = batch.column(2).slice(a, b - a).to_pylist()
            ids = batch.column(0).slice(a, b - a).to_pylist()
            rows = [(r, d, s.tobytes()) for d, s, rs in zip(ids, sets, regions) for r in rs]
            for i in range(0, len(rows), 256):
                part = list(zip(*rows[i:i + 256]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64()), pa.array(part[2], pa.binary())],
                    names=["region", "doc_id", "shingles"])


def _common(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate((x, y))
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Numbers of common shingles of all pairs of sets."""
    n = len(sets)
    words = np.concatenate(sets)
    row = np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(words, kind="stable")
    words, row = words[order], row[order]
    first = np.flatnonzero(np.concatenate(([True], words[1:] != words[:-1])))
    size = np.diff(np.append(first, len(words)))
    overlap = np.zeros((n, n), dtype=np.float32)
    for k in range(2, RARE + 1):
        own = row[first[size == k][:, None] + np.arange(k)]
        for i in range(k - 1):  # rows rise within a word
            for j in range(i + 1, k):
                for low in range(0, len(own), 1 << 20):
                    part = own[low:low + (1 << 20)]
                    np.add.at(overlap, (part[:, i], part[:, j]), 1)
    often = size > RARE
    column = np.repeat(np.where(often, np.cumsum(often) - 1, -1), size)
    row, column = row[column >= 0], column[column >= 0]
    full = np.zeros((n, n), dtype=np.float32)
    for low in range(0, int(often.sum()), 4096):
        a, b = np.searchsorted(column, (low, low + 4096))
        m = np.zeros((n, min(4096, int(often.sum()) - low)), dtype=np.float32)
        m[row[a:b], column[a:b] - low] = 1
        full += m @ m.T
    return full + overlap + overlap.T


def _chains(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links that join what a symmetric matrix of links joins, one fewer than a component has members."""
    fresh = np.ones(len(linked), dtype=bool)
    for start in range(len(linked)):
        if not fresh[start]:
            continue
        fresh[start] = False
        ahead = [start]
        while ahead:
            i = ahead.pop()
            found = np.flatnonzero(linked[i] & fresh)
            fresh[found] = False
            yield from ((i, j) for j in found.tolist())
            ahead += found.tolist()


def _linked(percent: int):
    """Links of a region confirmed on full sets: enough of them to join what is joined (a, b)."""

    def work(f: pd.DataFrame) -> Iterator[pd.DataFrame]:
        ids = f.doc_id.to_numpy()
        out: list[tuple[int, int]] = []
        for a, b in _runs(f.region.to_numpy()):
            if b - a < 2:
                continue
            sets = [np.frombuffer(s, dtype=np.uint64) for s in f.shingles.iloc[a:b]]
            size = np.array([len(s) for s in sets])
            if b - a > 12:  # all overlaps of the region at once
                overlap = _overlaps(sets)
                linked = np.empty(overlap.shape, dtype=bool)
                for i, own in enumerate(overlap):
                    own = own.astype(np.int64)
                    linked[i] = 100 * own >= percent * (size[i] + size - own)
                out += [(ids[a + i], ids[a + j]) for i, j in _chains(linked)]
                continue
            linked = np.zeros((b - a, b - a), dtype=bool)
            for i in range(b - a):
                for j in range(i + 1, b - a):
                    if 100 * min(size[i], size[j]) >= percent * max(size[i], size[j]):
                        same = _common(sets[i], sets[j])
                        linked[i, j] = linked[j, i] = 100 * same >= percent * (size[i] + size[j] - same)
            out += [(ids[a + i], ids[a + j]) for i, j in _chains(linked)]
        if out:
            yield pd.DataFrame(out, columns=["a", "b"])

    return _by_run(work)


def near_duplicates(docs: DataFrame, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of near-duplicate documents: (doc_id, n_shingles, component_id, kept), one row per row of ``docs``.

    Two documents are linked when 100 * |A and B| >= ``percent`` * |A or B| of their shingle sets. ``component_id`` is the
    smallest id reachable over links, ``kept`` is true for that one. A null or empty text, or one of white space only, has
    no shingle and is linked with nothing. Repeated rows come out repeated; rows with a null id are a group of their own
    with a null component and are kept. Extra columns are ignored.
    """
    spark, limit = docs.sparkSession, percent / 100
    ship(spark)
    src = pick(docs, id_col, text_col).toDF("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = stage(src.mapInArrow(_describe, "doc_id long, n_shingles long, k1 long, k2 long, sig binary"), "signatures")
    # Equal sets fall together before anything is compared.
    full = rows.where("n_shingles > 0 and doc_id is not null")
    first = full.groupBy("k1", "k2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"))
    reps = stage(first.select(F.col("rep").alias("doc_id"), "n_shingles", "k1", "k2", "sig"), "sets")
    sigs = reps.select("doc_id", "sig")

    regions, crowded = _regions(sigs)
    per_doc = regions.groupBy("doc_id").agg(F.collect_list(F.struct("tree", "region")).alias("own"))
    # doc -> its region in every tree, as bytes: pairs that met in an earlier tree are told from these.
    members = reps.select("doc_id", "n_shingles", "sig")
    spread = members.join(per_doc, "doc_id").mapInPandas(_spread(TREES), "region long, tree smallint, doc_id long, "
                                                         "n_shingles long, sig binary, regions binary")
    met = stage(spread.repartition("region").sortWithinPartitions("region", "doc_id").mapInPandas(
        _meet(limit), "doc_id long, region long"), "meetings")
    if not crowded.isEmpty():
        met = met.unionByName(_block_pairs(reps, crowded, limit))

    wanted = met.groupBy("doc_id").agg(F.collect_set("region").alias("regions"))
    texts = src.where("doc_id is not null").join(wanted.hint("shuffle_hash"), "doc_id").select("doc_id", "text", "regions")
    sets = texts.mapInArrow(_sets_by_region, "region long, doc_id long, shingles binary")
    links = stage(sets.repartition("region").sortWithinPartitions("region", "doc_id").mapInPandas(
        _linked(percent), "a long, b long"), "links")

    joined = components(links)
    # A component's smallest member is the smallest of its sets' smallest members.
    named = reps.select("k1", "k2", "n_shingles", "doc_id").join(joined.withColumnRenamed("node", "doc_id"), "doc_id", "left")
    named = named.select("k1", "k2", "n_shingles", F.coalesce("component", "doc_id").alias("component"))
    out = rows.select("doc_id", "n_shingles", "k1", "k2").join(named, ["k1", "k2", "n_shingles"], "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id")).select(
        "doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _spread(trees: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for low in range(0, len(f), 512):
                out = []
                for d, n, sig, own in f.iloc[low:low + 512].itertuples(index=False, name=None):
                    at = np.zeros(trees, dtype=np.int64)
                    pairs = [(o["tree"], o["region"]) for o in own]
                    for t, r in pairs:
                        at[t] = r
                    packed = at.tobytes()
                    out += [(r, t, d, n, sig, packed) for t, r in pairs]
                if out:
                    yield pd.DataFrame(out, columns=["region", "tree", "doc_id", "n_shingles", "sig", "regions"])

    return run


def drop_near_duplicates(docs: DataFrame, percent: int = 85) -> DataFrame:
    """``docs`` with one row of each group, the one with the smallest id; columns as they are.

    Rows are grouped and dropped one by one, whatever their id: of equal rows one stays, a text of its own stays under an id
    that another group uses, and rows with a null id take part, behind those with an id. Rows without a shingle all stay.
    """
    plain, at = numbered(docs)
    rows = stage(plain.withColumn("row", F.monotonically_increasing_id()), "rows")  # fixes the numbers
    groups = near_duplicates(rows.select(F.col("row").alias("doc_id"), F.col(at["text"]).alias("text")), percent)
    doc = F.col(at["doc_id"]).cast("long")
    ids = rows.select(F.col("row").alias("doc_id"), doc.alias("id"))
    place = F.struct(F.col("id").isNull().alias("none"), "id", F.col("doc_id").alias("row"))
    named = ids.join(groups.select("doc_id", "component_id"), "doc_id")
    kept = named.groupBy("component_id").agg(F.min(place).alias("best")).select(F.col("best.row").alias("row"))
    return rows.join(kept, "row", "left_semi").drop("row").toDF(*docs.columns)
