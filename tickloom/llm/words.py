"""Words of a batch of texts: their names, and 64-bit hashes for features.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``; as those are ASCII, working on
UTF-8 bytes is exact.

Where a result depends on two words being equal, ``Names`` tells them apart: 128 bits of a keyed
BLAKE2b of the word's bytes, in two halves. Any two of N different contents share a name with
probability N**2 / 2**129: under 2e-15 for 10**12 of them.

``Prefix`` is for features only, whose collisions cost accuracy at most: a polynomial over random
byte values modulo 2**64 (prefix sums give every word of a batch in one pass), finished by a
bijective mixer. Different contents can be built that share such a hash.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np

from .base import KEPT

_M64 = (1 << 64) - 1
_P = np.uint64(0x9E3779B97F4A7C15)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240101)
_EXACT = _rng.integers(1, _M64, 256, dtype=np.uint64, endpoint=True) | np.uint64(1)
_LOWER = _EXACT.copy()
_LOWER[65:91] = _EXACT[97:123]
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (three xor-shifts, two odd multiplications)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _pow, _inv
    if len(_pow) <= n:
        size = max(2 * len(_pow), n + 1, 1 << 16)
        p = np.full(size, _P, np.uint64)
        q = np.full(size, _PINV, np.uint64)
        p[0] = q[0] = 1
        _pow, _inv = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _pow, _inv


def _forget() -> None:
    global _pow, _inv
    _pow, _inv = np.ones(1, np.uint64), np.ones(1, np.uint64)


KEPT.append(_forget)


class Prefix:
    """Prefix sums over a byte array; ``span(a, b)`` hashes any byte ranges of it."""

    def __init__(self, data: np.ndarray, lower: bool = False):
        p, self.inv = _powers(len(data))
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((_LOWER if lower else _EXACT)[data] * p[: len(data)], out=self.sums[1:])

    def span(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.inv[a])


def bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first): byte bounds of every word, and by row the index of its first word."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets] = True
    before = cut[:-1].copy()
    before[1:] |= ~word[:-1]
    after = cut[1:].copy()
    after[:-1] |= ~word[1:]
    start = np.flatnonzero(word & before)
    end = np.flatnonzero(word & after) + 1
    return start, end, np.searchsorted(start, offsets)


#: Fixed key of all names; names of different runs are comparable.
KEY = b"tickloom content names"
#: Words that a worker process remembers; beyond that its memory starts anew (names don't change).
REMEMBERED = 150_000


def content_name(raw: bytes) -> bytes:
    """128 bits that stand for a content (see Names)."""
    return hashlib.blake2b(raw, digest_size=16, key=KEY).digest()


class Names(dict):
    """word (bytes) → its row in ``halves()``, the words' 128-bit names as two columns."""

    def __init__(self):
        super().__init__()
        self._raw = bytearray()

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self._raw += content_name(word)
        return i

    def halves(self) -> np.ndarray:
        return np.frombuffer(bytes(self._raw), "<u8").reshape(-1, 2)

    def of(self, rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(high, low, first): halves of the names of all rows' words, and each row's first."""
        if len(self) > REMEMBERED:
            self.clear()
            self._raw = bytearray()
        first = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) for r in rows], out=first[1:])
        at = np.fromiter(map(self.__getitem__, chain.from_iterable(rows)), np.int64, int(first[-1]))
        both = self.halves()[at]
        return np.ascontiguousarray(both[:, 0]), np.ascontiguousarray(both[:, 1]), first


def distinct(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different names of a row, sorted by (high, low)."""
    if len(high) < 2:
        return high, low
    order = high.argsort(kind="stable")
    h, l = high[order], low[order]  # noqa: E741
    same = h[1:] == h[:-1]
    if not same.any():
        return h, l
    if (l[1:] != l[:-1])[same].any():  # one half collides: sort by both
        order = np.lexsort((low, high))
        h, l = high[order], low[order]  # noqa: E741
        same = (h[1:] == h[:-1]) & (l[1:] == l[:-1])
    keep = np.append(True, ~same)
    return h[keep], l[keep]


_C = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA5A3564E27F8868B, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)]


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, first): k-word shingles by row, in order; a shorter row's whole sequence is one.

    ``words`` is one half of the words' names; the two halves' shingles are independent. Rows without words have none. Sequences of different length never share a hash seed.
    """
    n = first[1:] - first[:-1]
    per = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    at = np.zeros(len(per) + 1, np.int64)
    np.cumsum(per, out=at[1:])
    out = np.empty(at[-1], np.uint64)
    if not at[-1]:
        return out, at
    if len(words) >= k:
        run = words[: len(words) - k + 1] * _C[0]
        for j in range(1, k):
            run = run + (words[j : len(words) - k + 1 + j] ^ np.uint64(j)) * _C[j % 5] * np.uint64(2 * (j // 5) + 1)
        run = mix(run)
    else:
        run = np.empty(0, np.uint64)
    # within a row the shingles stand where its words start: one gather copies all whole rows
    row = np.repeat(np.arange(len(per)), per)
    pos = np.arange(at[-1]) - at[:-1][row] + first[:-1][row]
    whole = (n >= k)[row]
    out[whole] = run[pos[whole]]
    for i in np.flatnonzero((n > 0) & (n < k)):
        w = words[first[i] : first[i + 1]]
        j = np.arange(len(w))
        x = ((w ^ j.astype(np.uint64)) * np.array(_C)[j % 5]).sum(keepdims=True) + np.array([len(w)], np.uint64) * _C[4]
        out[at[i]] = mix(x ^ np.uint64(0x5851F42D4C957F2D))[0]
    return out, at
