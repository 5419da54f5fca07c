"""Column-wise construction of an aligned collection's Burrows-Wheeler transform and common prefixes.

The texts of a collection are aligned at a place in each. Each round inserts one symbol of every text, from the right
end to the left: the order of all suffixes that start at a column follows from the last round's order by a stable
distribution over the new symbols, and the common prefix of two neighbours that share a symbol is one more than the
least common prefix between the places they had. A text joins at its last symbol, as an empty suffix before all others,
and leaves after its first. Both arrays are read in sequence and written anew each round, and hold one entry for each
text: the positional form of the transform.

Strings that can match stand at the same distance from the aligned place, so no others have to be sorted together.
"""

from __future__ import annotations

import numpy as np


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n))
    return int(differ[0]) if len(differ) else n


class Collection:
    def __init__(self, texts: list[bytes], at: list[int]) -> None:
        """at: the aligned place in each text."""
        self.at = np.array(at, np.int64)
        self.tails = np.array([len(t) for t in texts], np.int64) - self.at
        self.right = int(self.tails.max(initial=0))  # columns from the aligned place on
        self.columns = np.zeros((self.right + int(self.at.max(initial=0)), len(texts)), np.uint8)
        for i, t in enumerate(texts):
            lo = self.right - int(self.tails[i])
            self.columns[lo : lo + len(t), i] = np.frombuffer(t, np.uint8)[::-1]
        self.order = self.lcp = np.zeros(0, np.int64)

    def _insert(self, r: int) -> None:
        """Column r from the right: one more symbol of the texts that have one there."""
        j = r - self.right + 1  # columns to the left of the aligned place
        stay = np.flatnonzero(self.at[self.order] >= j)
        if len(stay) < len(self.order):
            if len(stay):
                self.lcp = np.minimum.reduceat(self.lcp[: stay[-1] + 1], np.concatenate([[0], stay[:-1] + 1]))
                self.lcp[0] = 0
            self.order, self.lcp = self.order[stay], self.lcp[: len(stay)]
        new = np.flatnonzero((self.tails == self.right - r) & (self.at >= j))
        if len(new):
            self.order = np.concatenate([new, self.order])
            self.lcp = np.concatenate([np.zeros(len(new), np.int64), self.lcp])
        symbols = self.columns[r][self.order]
        old = np.argsort(symbols, kind="stable")
        shared = np.zeros(len(old), np.int64)
        same = np.flatnonzero(symbols[old][1:] == symbols[old][:-1]) + 1
        if len(same):
            shared[same] = 1 + range_minima(self.lcp, old[same - 1] + 1, old[same])
        self.order, self.lcp = self.order[old], shared

    def repeated(self, length: int) -> list[np.ndarray]:
        """For each text, the starts (up to its aligned place) of substrings of ``length`` that another text has at the
        same distance from its own."""
        texts, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for r in range(len(self.columns)):
            self._insert(r)
            j = r - self.right + 1
            if j < 0:
                continue
            long = self.lcp >= length
            long[:-1] |= long[1:]
            hit = self.order[long]
            texts.append(hit)
            starts.append(self.at[hit] - j)
        which, where = np.concatenate(texts), np.concatenate(starts)
        order = np.lexsort((where, which))
        which, where = which[order], where[order]
        return np.split(where, np.searchsorted(which, np.arange(1, len(self.at))))


def range_minima(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least x of each range [a, b], from minima over powers of two."""
    level = np.floor(np.log2(b - a + 1)).astype(np.int64)
    out = np.empty(len(a), x.dtype)
    table = x
    for k in range(int(level.max()) + 1):
        if k:
            d = 1 << (k - 1)
            table = np.minimum(table[:-d], table[d:])
        s = np.flatnonzero(level == k)
        out[s] = np.minimum(table[a[s]], table[b[s] - (1 << k) + 1])
    return out
