"""Word shingles of whole texts as 64-bit hashes, worked out on the byte buffers of Arrow columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_rng = np.random.default_rng(20_250_101)
_BYTE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
for _c in range(65, 91):  # A-Z count as a-z
    _BYTE[_c] = _BYTE[_c + 32]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ROW = _rng.integers(0, 2**64, 64, dtype=np.uint64) | np.uint64(1)
_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(1 << (n - 1).bit_length(), _BASE, dtype=np.uint64)
        steps[0] = 1
        _powers = np.cumprod(steps, dtype=np.uint64)
    return _powers[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the word."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_range(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte range; the ranges are in order and do not overlap."""
    power = _power(int((ends - starts).max()) + 1)
    size = ends - starts
    at = np.arange(int(size.sum()), dtype=np.int64)
    first = np.cumsum(size) - size
    inside = at - np.repeat(first, size)
    value = _BYTE[data[inside + np.repeat(starts, size)]] * power[inside]
    return mix(np.add.reduceat(value, first) + size.astype(np.uint64) * _ROW[63])


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in ``data``, and the number of words up to each text boundary."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    solid = ~_SPACE[data]
    fresh = np.zeros(len(data) + 1, dtype=bool)
    fresh[bounds] = True
    before = np.concatenate(([False], solid[:-1]))
    starts = np.flatnonzero(solid & (~before | fresh[:-1]))
    after = np.concatenate((solid[1:], [False]))
    ends = np.flatnonzero(solid & (~after | fresh[1:])) + 1
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    out, low, done = [], 0, np.cumsum(ends - starts)
    while low < len(starts):  # about a megabyte of words at a time
        high = max(low + 1, int(np.searchsorted(done, (done[low - 1] if low else 0) + (1 << 20), side="right")))
        out.append(_hash_range(data, starts[low:high], ends[low:high]))
        low = high
    return np.concatenate(out), np.searchsorted(starts, bounds)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and text boundaries of a string column; a null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0]:bounds[-1]], bounds - bounds[0]


def slices(texts: pa.Array, max_bytes: int = 2 << 20):
    """Row ranges of a column that hold about ``max_bytes`` each (one text at least), to bound working memory."""
    _, bounds = text_buffer(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(bounds, bounds[low] + max_bytes, side="right")) - 1)
        yield low, min(high, len(texts))
        low = min(high, len(texts))


def shingle_sets(texts: pa.Array, width: int = 5) -> list[np.ndarray]:
    """Per text its distinct ``width``-word shingles as sorted hashes. A text with fewer words is one shingle; one
    without words is empty."""
    if not len(texts):
        return []
    data, bounds = text_buffer(texts)
    words, upto = word_hashes(data, bounds)
    n = max(0, len(words) - width + 1)
    runs = np.zeros(n, dtype=np.uint64)
    for j in range(width):
        runs += words[j:j + n] * _ROW[j]
    runs = mix(runs)
    out = []
    for a, b in zip(upto[:-1].tolist(), upto[1:].tolist()):
        if b - a >= width:
            out.append(np.unique(runs[a:b - width + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _ROW[:b - a]).sum(keepdims=True) + _ROW[32 + b - a]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
