"""Content-defined anchors: each fixed-length string's least k-gram, which equal strings share at the same place."""

from __future__ import annotations

import numpy as np

from docloom.llm._bytes import PrimeHash, byte_values, prefix_hash, spans_hash

#: Bytes of an anchor's k-gram.
KGRAM = 32
PLAIN = byte_values(23, fold_case=False)
#: Two hashes modulo primes, of 62 bits together, unlike the one modulo 2**64.
PRIMES = PrimeHash((1 << 31) - 1, 1_103_515_245, 29), PrimeHash((1 << 31) - 19, 1_220_703_125, 31)


class StringHashes:
    """Names of substrings of ``data``: 64 bits of one hash and 62 of two others."""

    def __init__(self, data: np.ndarray) -> None:
        self.plain = prefix_hash(data, PLAIN)
        self.prime = [p.prefix(data) for p in PRIMES]

    def of(self, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = (p.spans(h, start, end) for p, h in zip(PRIMES, self.prime, strict=True))
        return spans_hash(self.plain, start, end), a << 31 | b


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in sequence, by running minima of blocks from both sides."""
    n = len(x) - width + 1
    size = -(-len(x) // width) * width
    padded = np.full(size, np.iinfo(x.dtype).max, x.dtype)
    padded[: len(x)] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int, prefix: np.ndarray, k: int = KGRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all strings of ``length`` bytes in ``data``, in runs with the same anchor: the anchor's hash and place, and
    the first and last start of the run's strings. prefix: prefix_hash(data, PLAIN). Of equal least k-grams in a string the leftmost is its anchor."""
    n = len(data) - length + 1
    if n < 1:
        return (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    at = np.arange(len(data) - k + 1)
    h = spans_hash(prefix, at, at + k)
    low = sliding_min(h, length - k + 1)
    # starts in sequence with the same minimum; inside those, the leftmost place at or after each start that has it
    change = np.ones(n, bool)
    change[1:] = low[1:] != low[:-1]
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n) - 1
    out_h, out_p, out_a, out_b = [], [], [], []
    for a, b in zip(starts, ends, strict=True):
        v = low[a]
        places = np.flatnonzero(h[a : b + length - k + 1] == v) + a
        lo = a
        for p in places:
            if lo > b:
                break
            hi = min(b, p)
            if hi >= lo:
                out_h.append(v), out_p.append(p), out_a.append(lo), out_b.append(hi)
                lo = hi + 1
    return np.array(out_h, np.uint64), np.array(out_p, np.int64), np.array(out_a, np.int64), np.array(out_b, np.int64)
