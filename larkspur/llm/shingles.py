"""Sets of word n-grams as sorted 64-bit hashes, computed for many texts at once.

Word hashes are polynomials over the bytes' random values, taken from running sums; an n-gram mixes
its words' hashes in order. Two different n-grams of a corpus agree with probability about 2**-64 a pair.
Texts are bytes (callers give empty ones for nulls); a text without words has no hashes and an empty set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on every bit."""
    x = x.astype(np.uint64)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


VALUES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
LOWERED = VALUES.copy()
LOWERED[65:91] = VALUES[97:123]
BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the life of the worker."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        have = np.full(max(n, (1 << 18) + (1 << 12)), base % 2**64, dtype=np.uint64)
        have[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(have)
    return have[:n]


def word_hashes(texts: list[bytes], values: np.ndarray = LOWERED) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, and the text it stands in."""
    data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
    if not len(texts) or len(data) < 2:
        return np.array([], np.uint64), np.array([], np.int64)
    sums = np.empty(len(data) + 1, dtype=np.uint64)
    sums[0] = 0
    np.cumsum(values[data] * powers(BASE, len(data)), out=sums[1:])
    space = SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space))))
    start, stop = edge[::2], edge[1::2]
    inverse = pow(BASE, -1, 2**64)
    hashes = (sums[stop] - sums[start]) * powers(inverse, len(data))[start]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return mixed(hashes + (stop - start).astype(np.uint64)), np.searchsorted(ends, start, "right")


def shingle_sets(texts: list[bytes], n: int, chunk: int = 1 << 18) -> Iterator[np.ndarray]:
    """The sorted distinct n-gram hashes of each text; fewer words than n: one hash of them all; none: empty."""
    at = 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) < chunk:
            size += len(texts[stop])
            stop += 1
        part = texts[at:stop]
        words, of = word_hashes(part)
        bounds = np.searchsorted(of, np.arange(len(part) + 1))
        grams = np.zeros(max(0, len(words) - n + 1), dtype=np.uint64)
        for j in range(n):
            grams += words[j : j + len(grams)] * np.uint64((BASE * (2 * j + 3)) % 2**64 | 1)
        grams = mixed(grams)
        for i in range(len(part)):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if b - a >= n:
                yield np.unique(grams[a : b - n + 1])
            elif b > a:
                short = sum((int(w) * (BASE * (2 * j + 3) | 1) for j, w in enumerate(words[a:b])), (b - a) << 7) % 2**64
                yield mixed(np.array([short ^ 0x5851F42D4C957F2D], dtype=np.uint64))
            else:
                yield np.array([], dtype=np.uint64)
        at = stop
