"""Token ids of whole texts from a tokenizer file, with each distinct unit of text encoded once in a worker.

The vocabulary's rule splits text at white space and between letters, digits and signs, and a merge never crosses such
a border. So texts are cut where two ASCII bytes make such a border beyond doubt, each distinct piece is encoded by
the tokenizer, and ids are gathered by array indexing. Texts that hold one of the vocabulary's special strings are
encoded whole. The store of pieces is a cache: when it has ``limit`` entries it starts anew.
"""

from __future__ import annotations

import re

import numpy as np
from tokenizers import Tokenizer, pre_tokenizers

from docloom.llm._bytes import SPACE, WORD_VALUES, prefix_hash, spans_hash
from docloom.llm._shared import keep_only

OTHER, LETTER, DIGIT, SIGN = range(4)
KIND = np.zeros(256, np.uint8)
KIND[[*range(65, 91), *range(97, 123)]] = LETTER
KIND[48:58] = DIGIT
KIND[[b for b in range(33, 127) if KIND[b] == OTHER and b != 39]] = SIGN
#: Pieces whose every character stands for itself before the merges: lower-case Latin letters in composed form.
PLAIN = re.compile("[a-z\xdf-\xf6\xf8-\xff]+")


def unit_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each piece, and each row's first piece."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    gap, kind = SPACE[data], KIND[data]
    cut = np.empty(len(data), bool)
    cut[0] = True
    a, b = kind[:-1], kind[1:]
    cut[1:] = gap[:-1] | ((a > 0) & (b > 0) & ((a != b) | (a == DIGIT)))
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(cut & ~gap)
    border = cut | gap
    edges = np.append(np.flatnonzero(border), len(data))
    end = edges[np.searchsorted(edges, start, side="right")]
    return start, end, np.searchsorted(start, offsets)


class UnitTokenizer:
    def __init__(self, path: str, limit: int = 500_000, recent: int = 50_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = str.maketrans({c: level.pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if PLAIN.match(c)})
        self.limit, self.most_recent = limit, recent
        self.clear()

    def clear(self) -> None:
        self.keys, self.at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.new_keys, self.new_at = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.starts, self.counts, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode_piece(self, text: str) -> list[int]:
        low = text.lower() if len(text.lower()) == len(text) else text
        if PLAIN.fullmatch(low) and all(c < "Ā" for c in text):
            return [t.id for t in self.tokenizer.model.tokenize(low.translate(self.letters))]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    @staticmethod
    def _find(keys: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
        if not len(keys):
            return np.full(len(h), -1)
        p = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        return np.where(keys[p] == h, at[p], -1)

    def _learn(self, data: np.ndarray, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        keys, first = np.unique(h, return_index=True)
        ids = [self.encode_piece(data[start[i] : end[i]].tobytes().decode("utf-8", "replace")) for i in first]
        n = np.array([len(x) for x in ids], np.int64)
        entry = len(self.starts) + np.arange(len(keys))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.concatenate([[0], np.cumsum(n)[:-1]])]).astype(np.int64)
        self.counts = np.concatenate([self.counts, n])
        self.pool = np.concatenate([self.pool, np.array([t for x in ids for t in x], np.uint32)])
        self.new_keys, self.new_at = np.concatenate([self.new_keys, keys]), np.concatenate([self.new_at, entry])
        order = np.argsort(self.new_keys, kind="stable")
        self.new_keys, self.new_at = self.new_keys[order], self.new_at[order]
        if len(self.new_keys) > self.most_recent:
            keys, at = np.concatenate([self.keys, self.new_keys]), np.concatenate([self.at, self.new_at])
            order = np.argsort(keys, kind="stable")
            self.keys, self.at = keys[order], at[order]
            self.new_keys, self.new_at = self.new_keys[:0], self.new_at[:0]

    def entries(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The store's entry of each piece, and each row's first piece."""
        if len(self.starts) > self.limit:
            self.clear()
        start, end, first = unit_spans(data, offsets)
        if not len(start):
            return start, first
        h = spans_hash(prefix_hash(data, WORD_VALUES), start, end)
        found = self._find(self.keys, self.at, h)
        lost = np.flatnonzero(found < 0)
        if len(lost):
            found[lost] = self._find(self.new_keys, self.new_at, h[lost])
            lost = lost[found[lost] < 0]
            if len(lost):
                self._learn(data, h[lost], start[lost], end[lost])
                found[lost] = self._find(self.new_keys, self.new_at, h[lost])
                lost = lost[found[lost] < 0]
                if len(lost):
                    found[lost] = self._find(self.keys, self.at, h[lost])
        return found, first

    def whole(self, data: np.ndarray, offsets: np.ndarray) -> dict[int, list[int]]:
        """Ids of the rows that hold a special string."""
        raw = data.tobytes()
        if not any(s in raw for s in self.special):
            return {}
        rows = [(i, raw[offsets[i] : offsets[i + 1]]) for i in range(len(offsets) - 1)]
        return {i: self.tokenizer.encode(t.decode("utf-8"), add_special_tokens=False).ids for i, t in rows if any(s in t for s in self.special)}

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Number of ids of each row."""
        found, first = self.entries(data, offsets)
        total = np.concatenate([[0], np.cumsum(self.counts[found])])
        out = total[first[1:]] - total[first[:-1]]
        for i, ids in self.whole(data, offsets).items():
            out[i] = len(ids)
        return out

    def ids(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All rows' ids in sequence, and where each row's begin."""
        found, first = self.entries(data, offsets)
        n = self.counts[found]
        total = np.concatenate([[0], np.cumsum(n)])
        index = np.repeat(self.starts[found] - total[:-1], n) + np.arange(total[-1])
        flat, begin = self.pool[index], total[first]
        special = self.whole(data, offsets)
        if special:
            rows = [np.array(special[i], np.uint32) if i in special else flat[begin[i] : begin[i + 1]] for i in range(len(begin) - 1)]
            flat, begin = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return flat, begin


_MADE: dict[str, UnitTokenizer] = {}


def unit_tokenizer(path: str) -> UnitTokenizer:
    """One for each file in a Python worker; Spark reuses workers, and so the store of pieces."""
    keep_only("tokenizer", _MADE.clear)
    if path not in _MADE:
        _MADE[path] = UnitTokenizer(path)
    return _MADE[path]
