"""Words and word n-grams of whole texts, in numpy, over UTF-8 bytes.

A word is a longest run of ``0-9``, ``a-z`` (``A-Z`` lower-cased) and every
code point from U+0080: the class ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``.
Bytes of code points from U+0080 are all >= 0x80, so the class can be applied
to bytes.  A word's hash is a polynomial of its bytes modulo 2**64, taken from
prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once (a longer single text is taken whole).
CHUNK = 1 << 19

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True

P = 0x9E3779B97F4A7C15
Q = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, P, np.uint64), np.full(n, pow(P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix finaliser)."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (null counts as empty)."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), off


def chunks(column: pa.Array, most: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo..hi with their bytes and offsets (from 0), some ``most`` bytes at a time."""
    data, off = texts_of(column)
    lo, n = 0, len(column)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most, "right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[off[lo]:off[hi]], off[lo:hi + 1] - off[lo]
        lo = hi


class Words:
    """The words of a chunk of texts: byte spans, hashes, and each text's range of words."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.low = LOWER[data]
        word = IS_WORD[self.low]
        n = len(word)
        begin, end = word.copy(), word.copy()
        if n:
            inner = off[(off > 0) & (off < n)]
            cut = np.zeros(n, bool)
            cut[inner] = True
            begin[1:] &= ~word[:-1] | cut[1:]
            end[:-1] &= ~word[1:] | cut[1:]
        self.start, self.end = np.flatnonzero(begin), np.flatnonzero(end) + 1
        up, down = _powers(1 << max(19, int(n + 1).bit_length()))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((self.low.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start])
        self.first = np.searchsorted(self.start, off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(off) - 1), self.count)

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether they end within the text."""
        n = len(self.hash)
        g = np.zeros(n, np.uint64)
        if n >= k:
            part = self.hash[:n - k + 1].copy()
            for j in range(1, k):
                part = part * Q + self.hash[j:n - k + 1 + j]
            g[:n - k + 1] = mix(part)
        return g, np.arange(n) + k <= self.first[1:][self.doc]

    def text(self, lo: int, hi: int) -> str:
        """Words lo..hi joined by one space."""
        return " ".join(self.low[s:e].tobytes().decode("utf-8", "replace")
                        for s, e in zip(self.start[lo:hi].tolist(), self.end[lo:hi].tolist(), strict=True))


def shingles(words: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each text, end to end, and their offsets.

    A text of fewer than k words, but not none, has one shingle: all its words.
    """
    g, ok = words.grams(k)
    value, doc = g[ok], words.doc[ok]
    for c in range(1, k):
        short = np.flatnonzero(words.count == c)
        if len(short):
            whole = mix(words.grams(c)[0][words.first[short]] ^ np.uint64(c))
            value, doc = np.concatenate([value, whole]), np.concatenate([doc, short])
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[keep], doc[keep]
    return value, np.searchsorted(doc, np.arange(len(words.count) + 1))
