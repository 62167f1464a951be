"""Token ids of whole texts with a public tokenizer file, with a bounded cache of words per worker process."""

from __future__ import annotations

import json
import os
import string
import unicodedata
import zlib

import numpy as np

CACHE_WORDS = 500_000
_MARKS = string.punctuation
#: White space to Python but not to the tokenizer, and the start of its special tokens.
_ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
_loaded: dict[int, WordTokenizer] = {}


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _plain(text: str) -> bool:
    """Whether the tokenizer's normal form of a text is its lower case, and no mark in it has a meaning of its own."""
    return (text.isascii() or (unicodedata.is_normalized("NFC", text) and "\u0130" not in text and "\u03a3" not in text)) and not any(
        c in text for c in _ODD)


class WordTokenizer:
    """Ids of a tokenizer that never joins text across white space and marks the last token of each word.

    Texts are lower-cased and cut at white space, and the ids of a piece are kept from one text to the next. Unseen words are
    encoded many at a time, without the steps for normal forms that are theirs already; the word-end marks tell them apart
    again. Whatever does not fit this goes through the tokenizer whole.
    """

    def __init__(self, definition: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_str(definition)
        parts = json.loads(definition)
        steps = (parts["pre_tokenizer"] or {}).get("pretokenizers", [])
        parts |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
            {"type": "WhitespaceSplit"}, *(s for s in steps if s["type"] == "ByteLevel")]}}
        self.bare = Tokenizer.from_str(json.dumps(parts))
        vocab = self.full.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 65536 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype=self.dtype) for e in self.full.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces that are not in the newer half of the cache. A piece that is a new word with marks is kept as the word
        alone; it gets an entry of its own when it comes again."""
        if len(self.words) > CACHE_WORDS:
            self.older, self.words = self.words, {}
        words, older = self.words, self.older
        found: dict[str, bytes] = {}
        parts, odd, fresh, tails = [], [], {}, {}
        for p in pieces:
            known = older.get(p)
            if known is not None:
                words[p] = known
            elif p.isalpha() and len(p) <= 200:
                fresh[p] = None
            else:
                head = p.rstrip(_MARKS)
                if not head.isalpha() or len(p) > 200:
                    odd.append(p)
                    continue
                tail = p[len(head):]
                if tail not in words:
                    tails[tail] = None
                parts.append((p, head, tail))
        new = {}
        for _, head, _ in parts:
            if head not in words and head not in fresh:
                known = older.get(head)
                if known is not None:
                    words[head] = known
                else:
                    new[head] = None
        self._encode_plain([*fresh, *new])
        odd += tails
        for p, ids in zip(odd, self._ids(odd)):
            words[p] = ids.tobytes()
        for p, head, tail in parts:
            (found if head in new or head in fresh else words)[p] = words[head] + words[tail]
        return found

    def _encode_plain(self, words: list[str]) -> None:
        groups = [words[i:i + 64] for i in range(0, len(words), 64)]
        for group, e in zip(groups, self.bare.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, dtype=self.dtype)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(group) and cuts[-1] == len(ids):
                data, low, size = ids.tobytes(), 0, self.dtype.itemsize
                for w, high in zip(group, (cuts * size).tolist()):
                    self.words[w] = data[low:high]
                    low = high
            else:
                for w, own in zip(group, self._ids(group)):
                    self.words[w] = own.tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``dtype``; a null text has none."""
        get = self.words.get
        cut, rows, holes, missing = [], [], [], set()
        for t in texts:
            pieces = t.lower().split() if t and _plain(t) else None
            row = list(map(get, pieces)) if pieces else []
            cut.append(pieces)
            rows.append(row)
            if None in row:
                at = [i for i, x in enumerate(row) if x is None]
                holes.append((pieces, row, at))
                missing.update([pieces[i] for i in at])
        once = self._learn(list(missing)) if missing else {}
        words = self.words
        for pieces, row, at in holes:
            for i in at:
                p = pieces[i]
                row[i] = words[p] if p in words else once[p]
        return [self._ids([t])[0].tobytes() if t and p is None else b"".join(r) for t, p, r in zip(texts, cut, rows)]


def forget() -> None:
    """Gives up the tokenizers of this process and their caches, for work that needs the memory."""
    _loaded.clear()


def load(definition: str) -> WordTokenizer:
    """The tokenizer of this process for a definition; its cache of words lives as long as the worker."""
    key = zlib.crc32(definition.encode())
    if key not in _loaded:
        _loaded[key] = WordTokenizer(definition)
    return _loaded[key]
