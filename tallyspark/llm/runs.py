"""Periodic runs by internal pattern matching.

A run of smallest period q that is at least four periods long holds, for the power of two m with m <= q < 2 m, a whole
dyadic block: m words whose place is a multiple of m. That block occurs again q words on, so in the neighbouring window of
starts m to 2 m - 1 words on. The search, over the words of many texts at once (a text's words only ever match its own):

1. a suffix array by prefix doubling: the ranks after k rounds name all stretches of 2^k words, so they are the dyadic blocks'
   intervals of the suffix array, and they give the longest common extension of two places to either side;
2. a wavelet matrix over the suffix array answers range successor queries: the first occurrence of a block in its window, the
   next one and the last one. By periodicity all occurrences in one window are an arithmetic progression, kept as start,
   step and number;
3. distances of the progression are candidate periods. Extending block and occurrence as far as they agree gives the run; of
   equal stretches the smallest period stays.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import pick, ship

#: Least length of a run in words, and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Texts are worked on together up to so many words; a longer text is worked on alone.
BATCH_WORDS = 131_072


class Ranks:
    """Suffix array of many texts by prefix doubling, and the rank of every place among stretches of 1, 2, 4, ... words.

    ``words`` holds word numbers from 1, each text followed by a 0. A rank is the first slot of the suffix array whose suffix
    begins with the same stretch of the same text. Rounds end when no stretch repeats or would be of use.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray, first: np.ndarray, longest: int):
        n = len(words)
        key = text * (int(words.max()) + 1) + words
        self.slots = np.argsort(key, kind="stable").astype(np.int32)
        self.levels: list[np.ndarray] = []
        #: For each level the dyadic blocks that occur more than once: place, and the slots of their occurrences.
        self.blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rank, slots, key = np.zeros(n, dtype=np.int32), np.arange(n, dtype=np.int32), key[self.slots]
        place, width = self.slots.copy(), 1
        while True:
            new = np.append(True, key[1:] != key[:-1])
            heads = np.flatnonzero(new)
            size = np.repeat(np.diff(np.append(heads, len(key))), np.diff(np.append(heads, len(key))))
            low = np.repeat(slots[heads], np.diff(np.append(heads, len(key)))).astype(np.int32)
            rank = rank.copy()
            rank[place] = low
            self.levels.append(rank)
            again = size > 1
            place, low, size, slots = place[again], low[again], size[again], slots[again]
            dyadic = (place - first[place]) % width == 0
            self.blocks.append((place[dyadic], low[dyadic], (low + size)[dyadic]))
            if not len(place) or 2 * width * LEAST_PERIODS > longest:
                return
            key = rank[place].astype(np.int64) * n + rank[place + width]
            order = np.argsort(key, kind="stable")
            key, place, width = key[order], place[order], 2 * width
            self.slots[slots] = place

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` on equal those from ``j`` on; i < j, both in one text."""
        length = np.zeros(len(i), dtype=np.int64)
        for k, rank, going in self._steps(len(i)):
            while len(going):
                going = going[rank[i[going] + length[going]] == rank[j[going] + length[going]]]
                length[going] += 1 << k
                if k + 1 < len(self.levels):
                    break
        return length

    def behind(self, i: np.ndarray, j: np.ndarray, first: np.ndarray) -> np.ndarray:
        """How many words before ``i`` equal those before ``j``; ``first`` is where the text begins."""
        length = np.zeros(len(i), dtype=np.int64)
        for k, rank, going in self._steps(len(i)):
            while len(going):
                back = length[going] + (1 << k)
                going = going[i[going] - back >= first[going]]
                back = length[going] + (1 << k)
                going = going[rank[i[going] - back] == rank[j[going] - back]]
                length[going] += 1 << k
                if k + 1 < len(self.levels):
                    break
        return length

    def _steps(self, n: int):
        for k in reversed(range(len(self.levels))):
            yield k, self.levels[k], np.arange(n)


class WaveletMatrix:
    """Order statistics of any range of a sequence of whole numbers below ``2 ** bits``; every query works on many ranges."""

    def __init__(self, values: np.ndarray, bits: int):
        self.bits = bits
        self.zeros: list[np.ndarray] = []
        for bit in reversed(range(bits)):
            one = (values >> bit) & 1 == 1
            before = np.zeros(len(values) + 1, dtype=np.int32)
            np.cumsum(~one, out=before[1:])
            self.zeros.append(before)
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, x: np.ndarray) -> np.ndarray:
        """How many values of the range are less than ``x``."""
        count = np.zeros(len(low), dtype=np.int32)
        for bit, before in zip(reversed(range(self.bits)), self.zeros):
            low0, high0, one = before[low], before[high], (x >> bit) & 1 == 1
            count += np.where(one, high0 - low0, 0)
            low = np.where(one, before[-1] + low - low0, low0)
            high = np.where(one, before[-1] + high - high0, high0)
        return count

    def smallest(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value of the range that ``k`` others come before."""
        value, k = np.zeros(len(low), dtype=np.int64), k.copy()
        for bit, before in zip(reversed(range(self.bits)), self.zeros):
            low0, high0 = before[low], before[high]
            one = k >= high0 - low0
            k -= np.where(one, high0 - low0, 0)
            value += one.astype(np.int64) << bit
            low = np.where(one, before[-1] + low - low0, low0)
            high = np.where(one, before[-1] + high - high0, high0)
        return value

    def successor(self, low: np.ndarray, high: np.ndarray, x: np.ndarray, none: int) -> np.ndarray:
        """The least value of the range that is ``x`` or more; ``none`` where there is none."""
        k = self.below(low, high, x)
        out = np.full(len(low), none, dtype=np.int64)
        there = k < high - low
        out[there] = self.smallest(low[there], high[there], k[there])
        return out


def progressions(ranks: Ranks, matrix: WaveletMatrix, level: int, first: np.ndarray, size: np.ndarray):
    """Occurrences of the blocks of a level in their neighbouring windows: (block, first occurrence, step, number), places in
    the joined words."""
    place, low, high = ranks.blocks[level]
    m = 1 << level
    if level == 0:  # windows of one place
        place = place[ranks.levels[0][place] == ranks.levels[0][place + 1]]
        return place, place + 1, np.ones(len(place), dtype=np.int64), np.ones(len(place), dtype=np.int64)
    long = size[place] >= LEAST_PERIODS * m
    place, low, high = place[long], low[long], high[long]
    none = 1 << matrix.bits
    at, end = (place - first[place]).astype(np.int64), none - 1
    found = matrix.successor(low, high, np.minimum(at + m, end), none)
    hit = found < at + 2 * m
    place, low, high, at, found = place[hit], low[hit], high[hit], at[hit], found[hit]
    step, number = np.ones(len(place), dtype=np.int64), np.ones(len(place), dtype=np.int64)
    second = matrix.successor(low, high, np.minimum(found + 1, end), none)
    many = np.flatnonzero(second < at + 2 * m)
    step[many] = second[many] - found[many]
    upto = matrix.below(low[many], high[many], np.minimum(at[many] + 2 * m, end))
    number[many] = upto - matrix.below(low[many], high[many], found[many])
    return place, found + first[place], step, number


def candidates(ranks: Ranks, block: np.ndarray, found: np.ndarray, step: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (block, occurrence) whose distance may be a period: one or two of each progression.

    Of three occurrences or more the block repeats its first ``step`` words, and so does the stretch around it and the one
    around the occurrences. A longer period moves the end of the one stretch to the end of the other; where both are one
    stretch, its own step is the period, which shorter blocks find.
    """
    two, many = number == 2, number > 2
    b, p, d = block[many], found[many], step[many]
    move = (p + d + ranks.ahead(p, p + d)) - (b + d + ranks.ahead(b, b + d))
    nth, rest = np.divmod(b + move - p, d)
    fits = (rest == 0) & (nth >= 0) & (nth < number[many])
    return (np.concatenate([block[~many], block[two], b[fits]]),
            np.concatenate([found[~many], (found + step)[two], (b + move)[fits]]))


def find_runs(words: np.ndarray, text: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, by start and period, as places in the joined words; end exclusive.

    Per place: word number (0 after each text), number of its text, place where the text begins, the text's number of words.
    """
    longest = int(size.max(initial=0))
    none = np.zeros(0, dtype=np.int64)
    if longest < LEAST_WORDS:
        return none, none, none
    ranks = Ranks(words, text, first, longest)
    matrix = WaveletMatrix(ranks.slots - first[ranks.slots], (longest + 1).bit_length())
    out = []
    for level in range(len(ranks.levels)):
        block, found, step, number = progressions(ranks, matrix, level, first, size)
        if not len(block):
            continue
        m = 1 << level
        block, again = candidates(ranks, block.astype(np.int64), found.astype(np.int64), step, number)
        period = again - block
        start = block - ranks.behind(block, again, first[block])
        end = again + m + ranks.ahead(block + m, again + m)
        own = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
        out.append(np.unique(np.stack([start[own], end[own], period[own]]), axis=1))
    start, end, period = np.concatenate(out, axis=1) if out else (none, none, none)
    order = np.lexsort((period, end, start))
    start, end, period = start[order], end[order], period[order]
    new = np.append(True, (start[1:] != start[:-1]) | (end[1:] != end[:-1]))[:len(start)]
    start, end, period = start[new], end[new], period[new]
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def _search(texts: list[bytes | None]) -> tuple[list[int], np.ndarray, pa.Array, list[bytes]]:
    """Numbers of words, runs per text, all runs in order, and the collapsed texts."""
    split = [t.split() if t else [] for t in texts]  # bytes are split at exactly the six blanks
    sizes = np.array([len(w) for w in split], dtype=np.int64)
    numbers: defaultdict[bytes, int] = defaultdict()
    numbers.default_factory = lambda: len(numbers) + 1
    words = np.zeros(int(sizes.sum()) + len(sizes), dtype=np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    for at, own in zip(begins.tolist(), split):
        words[at:at + len(own)] = list(map(numbers.__getitem__, own))
    text = np.repeat(np.arange(len(sizes)), sizes + 1)
    start, end, period = find_runs(words, text, begins[text], sizes[text])
    per_text = np.bincount(text[start], minlength=len(sizes))
    dropped = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(dropped, start + period, 1)
    np.add.at(dropped, end, -1)
    kept = np.cumsum(dropped)[:-1] == 0
    collapsed = [b" ".join(compress(own, kept[at:at + len(own)].tolist()) if runs else own)
                 for own, at, runs in zip(split, begins.tolist(), per_text.tolist())]
    runs = pa.StructArray.from_arrays([pa.array(start - begins[text[start]], pa.int64()), pa.array(end - start, pa.int64()),
                                       pa.array(period, pa.int64())], names=["start", "length", "period"])
    return sizes.tolist(), per_text, runs, collapsed


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.binary()).to_pylist()
        low = 0
        while low < len(texts):
            high, weight = low, 0
            while high < len(texts) and (high == low or weight + len(texts[high] or b"") <= 6 * BATCH_WORDS):
                weight, high = weight + len(texts[high] or b""), high + 1
            sizes, per_text, runs, collapsed = _search(texts[low:high])
            offsets = pa.array(np.append(0, np.cumsum(per_text)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [ids.slice(low, high - low), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, runs),
                 pa.array(collapsed, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "runs", "collapsed"])
            low = high


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row: all periodic runs of its words, and the text without their repeats.

    Words are what lies between blanks (space, tab, line feed, vertical tab, form feed, carriage return). A run is a stretch of
    words with smallest period q, of at least 6 words and 4 q, that no neighbouring word extends; ``runs`` holds (start,
    length, period) in words, by start, then period. ``collapsed`` is the words that no run holds after its first period, with
    one space between them.

    Texts are searched whole, however long; memory grows with the longest one, by some hundred bytes a word. A null, empty or
    blank text has no words, no runs and an empty collapsed text. Every row gives one row, repeated ones and those with a null
    doc_id too. Columns are read by exact name, so others of a clashing name do not matter. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    src = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return src.mapInArrow(_run, "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
