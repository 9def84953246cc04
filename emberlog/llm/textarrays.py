"""Vectorised token and window hashing over Arrow string columns.

A *word* is a maximal run of bytes other than the six ASCII white-space
characters (``[ \\t\\n\\x0b\\f\\r]``, what Java's ``\\s`` matches).  All texts of a
slice are hashed together: a prefix sum of ``value[byte] * B**i`` modulo 2**64
gives every word's polynomial hash, and a second prefix sum over the word hashes
gives the Rabin-Karp hash of every window of ``n`` words, with no Python loop
over words or windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
_RNG = np.random.Generator(np.random.PCG64(0x5EED))
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.int64).astype(U) * U(2) + U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_B = 0x9E3779B97F4A7C15
_C = 0xD6E8FEB86659FD93
SLICE_BYTES = 1 << 21

#: For comparisons that ignore punctuation and case: all ASCII but letters and digits separates
#: words, and upper case hashes like lower case (for ASCII and, in UTF-8, the Latin-1 letters).
PLAIN_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
PLAIN_BYTE = _BYTE.copy()
PLAIN_BYTE[65:91] = PLAIN_BYTE[97:123]
PLAIN_BYTE[0x80:0x9F] = PLAIN_BYTE[0xA0:0xBF]


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(n - 1, 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U))
        return self.up[:n], self.down[:n]


#: Base of the worth of places: see ``windows``.
STEP = 0xA0761D6478BD642F
_bytes_powers, _word_powers, places = _Powers(_B), _Powers(_C), _Powers(STEP)


def mix(h: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3: spreads a hash over all bits."""
    h = h ^ (h >> U(33))
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its n + 1 offsets into them, from 0. Nulls are empty texts."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    n = len(texts)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    kind, width = (np.int64, 8) if wide else (np.int32, 4)
    offsets = np.frombuffer(texts.buffers()[1], kind, n + 1, texts.offset * width).astype(np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes each; a longer text is a range of its own."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, offsets = buffers(texts)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


class Words:
    """Words of a slice of texts.

    ``start`` and ``end``: byte positions in ``raw``; ``first``: n + 1 positions, where each text's
    words begin among all words.
    """

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, between: np.ndarray = _SPACE):
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        word = np.empty(n + 1, bool)
        np.logical_not(between[raw], out=word[:n])
        word[n] = False
        before = np.empty(n + 1, bool)
        before[0], before[1:] = False, word[:n]
        cuts = offsets[offsets < n]
        begin = word & ~before
        begin[cuts] = word[cuts]
        stop = before & ~word
        inner = cuts[cuts > 0]
        stop[inner] = before[inner]
        self.start = np.flatnonzero(begin)
        self.end = np.flatnonzero(stop)
        self.first = np.searchsorted(self.start, offsets)

    @classmethod
    def of(cls, texts: pa.Array, between: np.ndarray = _SPACE) -> Words:
        """``between``: which bytes separate words."""
        return cls(*buffers(texts), between)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self, values: np.ndarray = _BYTE) -> np.ndarray:
        """A 64-bit hash of each word; ``values`` may map several bytes to one value."""
        return hashes_between(self.raw, self.start, self.end, values)


def hashes_between(raw: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each stretch of bytes."""
    up, down = _bytes_powers.get(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, U)
    np.cumsum(values[raw] * up[:-1], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def window_hashes(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of all windows of ``n`` words that lie inside one text.

    Returns the hashes and the index of each window's first word among all words.
    """
    total = len(words)
    if total < n:
        return np.zeros(0, U), np.zeros(0, np.int64)
    up, down = _word_powers.get(total + 1)
    sums = np.zeros(total + 1, U)
    np.cumsum(words * up[:-1], out=sums[1:])
    inside = np.ones(total - n + 1, bool)
    counts = np.diff(first)
    # a window that starts in the last n - 1 words of a text runs over its end
    for k in range(1, n):
        at = first[1:][counts >= k] - k
        inside[at[at < len(inside)]] = False
    at = np.flatnonzero(inside)
    return mix((sums[at + n] - sums[at]) * down[at]), at
