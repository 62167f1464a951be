"""Best-fit packing by a linear grouping scheme.

Documents are cut only where they are longer than a window. Pieces are dealt by hash to shards of about ``SHARD_ROWS``
documents, each packed in one task:

1. pieces over ``LARGE`` of the window are sorted by length and cut into groups of equal cardinality; a length counts as the
   largest of its group, which leaves few sizes. Many groups waste less by rounding, few ones leave rooms that small pieces
   can use, so a few numbers of groups are tried;
2. the least number of windows for the few sizes is a linear program over configurations (how many pieces of each size share
   a window), solved by column generation; whole multiples of its configurations open windows;
3. actual pieces take the places of the rounded sizes, which they never exceed; the last place of a window goes to the
   longest piece that fits what is really left;
4. what the rounding of the program left over and all small pieces follow by falling length, each into the window with the
   least room that still takes it;
5. windows that stay loose, for want of small pieces, are emptied and their pieces placed as in 4, if that saves windows.
"""

from __future__ import annotations

import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import pick, ship
from tallyspark.llm.tokens import forget, load, tokenizer_file

WINDOW = 4096
SHARD_ROWS = 4096
#: Numbers of groups, tried in turn until the windows are as few as the tokens allow; the fewest windows count.
GROUPS = (16, 8, 32)
LARGE = 1 / 4
#: A window with more than this share of room is loose.
LOOSE = 1 / 64


def group_sizes(lengths: np.ndarray, groups: int) -> np.ndarray:
    """For lengths in falling order the largest of each one's group, groups being equally many neighbours."""
    at = np.arange(len(lengths)) * groups // max(1, len(lengths))
    first = np.searchsorted(at, np.arange(groups))
    return lengths[first[at]] if len(lengths) else lengths


def best_configuration(sizes: np.ndarray, worth: np.ndarray, window: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes that fits a window: (value, count of each size)."""
    value = np.zeros(window + 1)
    chosen = []
    for _ in range(window // int(sizes.min())):  # one more piece in each round
        more, pick_of = value.copy(), np.full(window + 1, -1)
        for g, (s, w) in enumerate(zip(sizes.tolist(), worth.tolist())):
            with_g = value[:window + 1 - s] + w
            better = with_g > more[s:] + 1e-12
            more[s:][better] = with_g[better]
            pick_of[s:][better] = g
        if (pick_of < 0).all():
            break
        chosen.append(pick_of)
        value = more
    count, room = np.zeros(len(sizes)), window
    for pick_of in reversed(chosen):
        g = pick_of[room]
        if g >= 0:
            count[g] += 1
            room -= int(sizes[g])
    return float(worth @ count), count


def configurations(sizes: np.ndarray, demand: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Optimal basis of the configuration program: (patterns as columns, how often each is used, fractions included)."""
    basis = np.diag((window // sizes).astype(float))
    used = demand / np.diag(basis)
    for _ in range(50 * len(sizes) + 100):
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        value, entering = best_configuration(sizes, np.maximum(worth, 0), window)
        if value <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, entering)
        can = step > 1e-9
        if not can.any():
            break
        ratio = np.where(can, used / np.where(can, step, 1), np.inf)
        out = int(ratio.argmin())
        used = np.maximum(used - ratio[out] * step, 0)
        used[out] = ratio[out]
        basis[:, out] = entering
    return basis, used


class Rooms:
    """Windows by the room they have left; finds the fullest one that takes a length."""

    def __init__(self, window: int):
        self.window = window
        self.by_room: list[list[int]] = [[] for _ in range(window + 1)]
        self.present = 0

    def put(self, number: int, room: int) -> None:
        if room:
            self.by_room[room].append(number)
            self.present |= 1 << room

    def take(self, length: int) -> tuple[int, int] | None:
        wide = self.present >> length
        if not wide:
            return None
        room = length + (wide & -wide).bit_length() - 1
        own = self.by_room[room]
        number = own.pop()
        if not own:
            self.present ^= 1 << room
        return number, room


class Left:
    """Pieces not placed yet; finds the longest one that is no longer than a limit."""

    def __init__(self, pieces: np.ndarray, lengths: np.ndarray, window: int):
        self.by_length: list[list[int]] = [[] for _ in range(window + 1)]
        self.present = 0
        for i in pieces[::-1].tolist():
            self.by_length[lengths[i]].append(i)
            self.present |= 1 << int(lengths[i])

    def take(self, limit: int) -> int | None:
        length = (self.present & ((2 << limit) - 1)).bit_length() - 1
        if length < 0:
            return None
        own = self.by_length[length]
        piece = own.pop()
        if not own:
            self.present ^= 1 << length
        return piece


def assign(lengths: np.ndarray, window: int = WINDOW, groups: tuple[int, ...] = GROUPS,
           large: float = LARGE) -> tuple[np.ndarray, np.ndarray]:
    """Window number and offset of every piece; lengths are 1 to ``window``. Depends on the lengths and their order only."""
    least = -(-int(lengths.sum()) // window)
    best, fewest = None, 0
    for g in groups:
        found = _assign(lengths, window, g, large)
        windows = int(found[0].max(initial=-1)) + 1
        if best is None or windows < fewest:
            best, fewest = found, windows
        if fewest == least:
            break
    return best


def _assign(lengths: np.ndarray, window: int, groups: int, large: float) -> tuple[np.ndarray, np.ndarray]:
    n = len(lengths)
    number, offset = np.full(n, -1), np.zeros(n, dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    sorted_lengths = lengths[order]
    whole = int((sorted_lengths == window).sum())  # a full window each
    number[order[:whole]] = np.arange(whole)
    big = order[whole:max(whole, int((sorted_lengths > large * window).sum()))]
    windows = whole
    filled: list[int] = []
    if len(big):
        rounded = group_sizes(lengths[big], groups)
        sizes, demand = np.unique(rounded, return_counts=True)
        left = Left(big, lengths, window)
        basis, used = configurations(sizes, demand.astype(float), window)
        for column in np.argsort(-used, kind="stable").tolist():
            places = sorted((int(s) for s, c in zip(sizes, basis[:, column]) for _ in range(int(round(c)))), reverse=True)
            for _ in range(int(used[column] + 1e-6)):
                at = 0
                for k, s in enumerate(places):
                    found = left.take(window - at if k + 1 == len(places) else s)
                    if found is not None:
                        number[found], offset[found] = windows, at
                        at += int(lengths[found])
                if at:
                    filled.append(at)
                    windows += 1
    rooms = Rooms(window)
    for w, at in enumerate(filled):
        rooms.put(whole + w, window - at)
    rest = order[whole:]
    rest = rest[number[rest] < 0]
    windows = best_fit(rest, lengths, number, offset, rooms, windows)
    room = window - np.bincount(number, weights=lengths, minlength=windows)
    loose = np.flatnonzero(room > LOOSE * window)
    again = order[np.isin(number[order], loose)]
    other_number, other_offset = number.copy(), offset.copy()
    fewer = best_fit(again, lengths, other_number, other_offset, Rooms(window), 0)
    if fewer < len(loose):
        kept = np.setdiff1d(np.arange(windows), loose)
        renumbered = np.zeros(windows, dtype=np.int64)
        renumbered[kept] = np.arange(len(kept))
        other_number[again] += len(kept)
        still = np.setdiff1d(order, again)
        other_number[still] = renumbered[number[still]]
        return other_number, other_offset
    return number, offset


def best_fit(pieces: np.ndarray, lengths: np.ndarray, number: np.ndarray, offset: np.ndarray, rooms: Rooms, windows: int) -> int:
    """Places pieces one by one, each into the window with the least room that takes it or into a new one; the number of
    windows then."""
    for i, size in zip(pieces.tolist(), lengths[pieces].tolist()):
        found = rooms.take(size)
        if found is None:
            found, windows = (windows, rooms.window), windows + 1
        number[i], offset[i] = found[0], rooms.window - found[1]
        rooms.put(found[0], found[1] - size)
    return windows


def _pieces(definition, end_id: int, window: int):
    """Token ids of whole texts, cut at full windows only."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(definition.value)
        gc.disable()  # nothing here is cyclic, and the collector would walk the cache of words again and again
        size = tok.dtype.itemsize
        end, step, row = np.array([end_id], dtype=tok.dtype).tobytes(), window * size, 0
        for batch in batches:
            for low in range(0, batch.num_rows, 1024):
                part = batch.slice(low, 1024)
                ids = [x + end for x in tok.encode(part.column(1).to_pylist())]
                at = [(i, s) for i, x in enumerate(ids) for s in range(0, len(x), step)]
                source = pa.array([i for i, _ in at], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(source), pa.array([row + i for i, _ in at], pa.int64()),
                     pa.array([s // size for _, s in at], pa.int64()), pa.array([ids[i][s:s + step] for i, s in at], pa.binary())],
                    names=["doc_id", "row", "start", "ids"])
                row += len(ids)
        gc.enable()

    return run


def _wide(ids: pa.Array, dtype: str) -> tuple[np.ndarray, pa.Array]:
    """Lengths of the pieces, and their ids as unsigned 32-bit integers, without an object for each piece."""
    size = np.dtype(dtype).itemsize
    _, ends, data = ids.buffers()
    ends = np.frombuffer(ends, np.int32)[ids.offset:ids.offset + len(ids) + 1]
    numbers = np.frombuffer(data, dtype=dtype, offset=int(ends[0]), count=int(ends[-1] - ends[0]) // size).astype("<u4")
    at = (ends - ends[0]) // size
    return np.diff(at).astype(np.int64), pa.BinaryArray.from_buffers(
        pa.binary(), len(ids), [None, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(numbers)])


def _pack(dtype: str, window: int, groups: tuple[int, ...], large: float):
    def run(pieces: pa.Table) -> pa.Table:
        forget()  # of the tokenizing before, in the same worker
        pieces = pieces.sort_by([("doc_id", "ascending"), ("row", "ascending"), ("start", "ascending")]).combine_chunks()
        lengths, ids = _wide(pieces["ids"].chunk(0), dtype)
        number, offset = assign(lengths, window, groups, large)
        base = pieces["shard"][0].as_py() << 32
        start = pieces["start"].to_numpy()
        return pa.table({"doc_id": pieces["doc_id"], "piece": pa.array(start // window, pa.int32()), "start": pieces["start"],
                         "sequence_id": pa.array(base + number, pa.int64()), "offset": pa.array(offset, pa.int64()), "ids": ids})

    return run


def pack_best_fit(docs: DataFrame, window: int = WINDOW, shard_rows: int = SHARD_ROWS, groups: tuple[int, ...] = GROUPS,
                  large: float = LARGE, end_id: int = 1, tokenizer_path: str | None = None) -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens: (doc_id, piece, start, sequence_id, offset, ids).

    A document is its token ids and then ``end_id``; a null or empty text is ``end_id`` alone. Only a document longer than
    ``window`` is cut, into full pieces and a last one that may be shorter, however long it is. ``ids`` holds the piece's ids
    as little-endian unsigned 32-bit integers, ``offset`` its place in the sequence, without gaps. Repeated rows, also those
    of one doc_id, and rows with a null doc_id are packed one by one; equal lengths are placed in the order of doc_id, then
    of the rows. Columns are read by exact name, so others of a clashing name do not matter. An empty table gives no piece.
    """
    spark = docs.sparkSession
    ship(spark)
    with open(tokenizer_path or tokenizer_file(), encoding="utf-8") as f:
        text = f.read()
    definition = spark.sparkContext.broadcast(text)  # as large as the tokenizer file
    src = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    shards = max(1, -(-src.count() // shard_rows))
    pieces = src.mapInArrow(_pieces(definition, end_id, window), "doc_id long, row long, start long, ids binary")
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "start"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(
        _pack(load(text).dtype.str, window, groups, large),
        "doc_id long, piece int, start long, sequence_id long, offset long, ids binary")
