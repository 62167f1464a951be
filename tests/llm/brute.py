"""Plain single-machine versions of what the operators return, and awkward rows to try them on."""

from __future__ import annotations

import hashlib
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, TEXT string, component_id string, ids string"


def awkward(spark):
    """Nulls in every column, empty, blank and very long texts, exact and near copies, a repeated row, clashing extra columns."""
    base = " ".join(f"word{i}" for i in range(60))
    near = base.replace("word30", "other")
    rows = [(1, base, "en", "a"), (2, base, "en", "a"), (3, near, "en", None), (4, None, None, None), (5, "", "en", "b"),
            (6, " \n\t ", "de", "b"), (7, "x y z", "de", "a"), (8, "X Y Z", "de", "a"), (9, "lorem " * 30_000, "en", "a"),
            (10, "12 34 ++", None, "b"), (11, base + " tail end of it", "en", "a"), (11, base + " tail end of it", "en", "a"),
            (None, "no id here", "en", "a"), (12, "héllo wörld ßé", "fr", "c")]
    return spark.createDataFrame([(*r, len(r[1]) if r[1] else None, "other", "clash", "clash") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(text: str | None) -> set:
    own = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(own[i:i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def near_duplicate_groups(docs: list[tuple[int, str | None]], percent: int = 85) -> dict[int, tuple[int, int]]:
    """doc_id -> (number of shingles, smallest id reachable)."""
    sets = {}
    for d, t in docs:
        sets.setdefault(d, []).append(shingles(t))
    top = {d: d for d in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {d: (len(sets[d][0]), root(d)) for d in ids}


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def paragraph_set(text: str) -> set:
    return {hashlib.md5(p.encode()).hexdigest()[:15] for p in re.sub(r"([.!?]) +", "\\1\n", text).split("\n") if p}
