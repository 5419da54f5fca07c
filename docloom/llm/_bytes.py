"""Vectorised work on the bytes of text columns: hashes of words, word n-grams and fixed-length strings.

A string's hash is a polynomial in its bytes modulo 2**64, where each byte counts as a random 64-bit number, then
mixed. With prefix sums every substring's hash costs a subtraction and a multiplication.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = U(0x9E3779B97F4A7C15)
#: Bytes looked at together; temporary arrays take about 60 times as much memory.
BLOCK = 1 << 18


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def byte_values(seed: int, fold_case: bool) -> np.ndarray:
    v = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
    if fold_case:
        v[65:91] = v[97:123]
    return v


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


class Powers:
    """Powers of an odd base and of its inverse, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, _inverse(base)
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, dtype=np.uint64)])) for b in (U(self.base), U(self.inverse)))


POWERS = Powers(int(BASE))


def prefix_hash(data: np.ndarray, values: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    """h of length len(data)+1 with h[j]-h[i] = sum of values[data[t]] * base**t for i <= t < j."""
    powers.reach(len(data) + 1)
    h = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(values[data] * powers.up[: len(data)], out=h[1:])
    return h


def spans_hash(h: np.ndarray, start: np.ndarray, end: np.ndarray, powers: Powers = POWERS) -> np.ndarray:
    return mix((h[end] - h[start]) * powers.down[start] + (end - start).astype(np.uint64))


class PrimeHash:
    """A polynomial in a string's bytes modulo a prime below 2**31, each byte counting as a random number."""

    def __init__(self, prime: int, base: int, seed: int) -> None:
        self.prime, self.values = prime, np.random.default_rng(seed).integers(1, prime, 256)
        self.bases = base % prime, pow(base, -1, prime)
        self.up = self.down = np.ones(1, np.int64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up, self.down = (np.concatenate([x, x * pow(b, k, self.prime) % self.prime]) for x, b in zip((self.up, self.down), self.bases, strict=True))

    def prefix(self, data: np.ndarray) -> np.ndarray:
        """Sums below 2**62 for data of less than 2**31 bytes; differences are reduced when they are asked for."""
        self.reach(len(data) + 1)
        h = np.zeros(len(data) + 1, np.int64)
        np.cumsum(self.values[data] * self.up[: len(data)] % self.prime, out=h[1:])
        return h

    def spans(self, h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (h[end] - h[start]) % self.prime * self.down[start] % self.prime


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets (nulls are empty) of a string or binary column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of about ``limit`` bytes; a longer row is a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
WORD_VALUES = byte_values(11, fold_case=True)


def word_spans(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (run without gap bytes, else ASCII white space, inside a row), and each row's first word."""
    gap = SPACE[data] if gap is None else gap
    begins = np.empty(len(data), dtype=bool)
    if len(data):
        begins[0] = True
        begins[1:] = gap[:-1]
        begins[offsets[:-1][offsets[:-1] < len(data)]] = True
        begins &= ~gap
    start = np.flatnonzero(begins)
    stop = np.empty(len(data), dtype=bool)
    if len(data):
        stop[-1] = True
        stop[:-1] = gap[1:]
        ends = offsets[1:] - 1
        stop[ends[ends >= 0]] = True
        stop &= ~gap
    end = np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray, gap: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (A-Z folded), start and end of each word, and each row's first word. Sections bound the memory for a very long row."""
    start, end, first = word_spans(data, offsets, gap)
    out = np.empty(len(start), dtype=np.uint64)
    i = 0
    while i < len(start):
        lo = start[i]
        j = max(int(np.searchsorted(end, lo + BLOCK, side="right")), i + 1)
        h = prefix_hash(data[lo : end[j - 1]], WORD_VALUES)
        out[i:j] = spans_hash(h, start[i:j] - lo, end[i:j] - lo)
        i = j
    return out, start, end, first


#: ASCII bytes that aren't letters or digits.
NOT_WORD = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
#: Of each code point: 1 a letter, digit or mark, 0 none of these, 2 not looked at yet.
LETTERS = np.full(1 << 21, 2, np.uint8)


def letter_gaps(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to no letter, digit or mark. Bytes that aren't UTF-8 count as letters."""
    gap = NOT_WORD[data]
    lead = np.flatnonzero(data >= 0xC2)
    if not len(lead):
        return gap
    wide = np.concatenate([data, np.zeros(3, np.uint8)])
    size = 2 + (data[lead] >= 0xE0) + (data[lead] >= 0xF0).astype(np.int64)
    cp = data[lead].astype(np.int64) & (0x7F >> size)
    whole = np.ones(len(lead), bool)
    for k in (1, 2, 3):
        b, inside = wide[lead + k], size > k
        whole &= ~inside | (b & 0xC0 == 0x80)
        cp = np.where(inside, cp << 6 | b & 0x3F, cp)
    lead, size, cp = lead[whole], size[whole], cp[whole]
    new = np.unique(cp[LETTERS[cp] == 2])
    LETTERS[new] = [c > 0x10FFFF or chr(c).isalnum() or unicodedata.category(chr(c))[0] == "M" for c in new.tolist()]
    other = LETTERS[cp] == 0
    for k in range(4):
        gap[lead[other & (size > k)] + k] = True
    return gap


#: Hashes of words with other than ASCII bytes: as they stand, and folded.
_FOLDED: dict[int, int] = {}


def forget_words() -> None:
    _FOLDED.clear()


def folded(word: bytes) -> bytes:
    """Equal for words that differ in case, or in how accents are encoded, in any script."""
    whole = unicodedata.normalize("NFD", word.decode("utf-8", "surrogateescape"))
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", whole.casefold())).encode("utf-8", "surrogateescape")


def letter_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash (Unicode case and composition folded), start and end of each run of letters, digits and marks, and each row's first."""
    out, start, end, first = word_hashes(data, offsets, letter_gaps(data))
    above = np.concatenate([[0], np.cumsum(data >= 0x80)])
    at = np.flatnonzero(above[end] > above[start])
    if len(at):
        raw, where, which = np.unique(out[at], return_index=True, return_inverse=True)
        keys = raw.tolist()
        if len(_FOLDED) > 100_000:  # a bound on memory
            _FOLDED.clear()
        new = [k for k, h in enumerate(keys) if h not in _FOLDED]
        if new:
            words = [folded(data[start[w] : end[w]].tobytes()) for w in at[where[new]]]
            ends = np.cumsum([len(w) for w in words])
            h = prefix_hash(np.frombuffer(b"".join(words), np.uint8), WORD_VALUES)
            _FOLDED.update(zip((keys[k] for k in new), spans_hash(h, np.append(0, ends[:-1]), ends).tolist(), strict=True))
        out[at] = np.array([_FOLDED[h] for h in keys], np.uint64)[which]
    return out, start, end, first


GRAM_SALTS = np.random.default_rng(5).integers(1, 1 << 63, 64, dtype=np.uint64) | U(1)


def gram_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word that has n in its row, and each row's first n-gram.

    A row of fewer words, but one at least, has its whole sequence as its only n-gram."""
    counts = np.diff(first)
    grams = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    begin = np.concatenate([[0], np.cumsum(grams)])
    out = np.zeros(int(begin[-1]), dtype=np.uint64)
    pos = np.arange(len(out)) - np.repeat(begin[:-1], grams) + np.repeat(first[:-1], grams)
    full = np.repeat(counts >= n, grams)
    at = pos[full]
    if len(at):
        acc = np.zeros(len(at), dtype=np.uint64)
        for k in range(n):
            acc += words[at + k] * GRAM_SALTS[k]
        out[full] = mix(acc)
    for r in np.flatnonzero((counts > 0) & (counts < n)):
        w = words[first[r] : first[r + 1]]
        out[begin[r]] = mix(np.array([(w * GRAM_SALTS[: len(w)]).sum() + U(len(w))], dtype=np.uint64))[0]
    return out, begin


def hash_of_set(values: np.ndarray) -> int:
    """One 64-bit number for a sorted array of distinct numbers."""
    a = mix(values + U(len(values)))
    return int(mix(np.array([a.sum(dtype=np.uint64) ^ mix(a).sum(dtype=np.uint64)], dtype=np.uint64))[0])


def check_of_set(values: np.ndarray, bits: int) -> int:
    """Bits of another hash of a sorted array of distinct numbers."""
    a = mix((values ^ U(0x5851F42D4C957F2D)) * U(0xDA942042E4DD58B5))
    return int(mix(np.array([np.bitwise_xor.reduce(a)]) + np.array([a.sum(dtype=np.uint64)]) * U(3))[0]) & (1 << bits) - 1
