"""Vectorised words and hashes over many texts at once."""

from __future__ import annotations

import numpy as np

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_POWERS = [np.ones(1, dtype=np.uint64)]


def lower_table() -> np.ndarray:
    """A byte table that lower-cases A-Z."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low


LOWER = lower_table()
# Letters, digits and everything beyond ASCII, after lower-casing.
ALNUM = np.isin(np.arange(256), [*range(48, 58), *range(97, 123), *range(128, 256)])
# Everything but space and \t \n \v \f \r.
VISIBLE = ~np.isin(np.arange(256), [32, *range(9, 14)])


def powers(n: int) -> np.ndarray:
    """The first n powers of an odd constant, modulo 2^64."""
    known = _POWERS[0]
    if len(known) < n:
        size = max(n, 4096)
        factors = np.full(size, np.uint64(0xD1342543DE82EF95))
        factors[0] = 1
        known = _POWERS[0] = np.multiply.accumulate(factors)
    return known[:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that each bit depends on all."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str], members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and how many each text has.

    A word is a maximal run of bytes in ``members`` after lower-casing A-Z.
    """
    coded = [t.encode("utf-8", "replace") for t in texts]
    data = LOWER[np.frombuffer(b"\n".join(coded) + b"\n", dtype=np.uint8)]
    inside = members[data]
    edge = np.flatnonzero(np.diff(inside, prepend=False))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), np.zeros(len(texts), dtype=np.int64)
    lengths = ends - starts
    offsets = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(offsets, lengths)
    value = (data[inside].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()))[place]
    hashes = mixed(np.add.reduceat(value, offsets) ^ (lengths.astype(np.uint64) * MULTIPLIER))
    bounds = np.cumsum([len(c) + 1 for c in coded])
    return hashes, np.diff(np.searchsorted(starts, bounds), prepend=0)


def gram_hashes(words: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of all k consecutive words of one sequence (of all there are, if fewer)."""
    if not len(words):
        return words
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.full(n, np.uint64(seed * 2 + 1), dtype=np.uint64)
    for j in range(k):
        h = mixed(h * MULTIPLIER + words[j : j + n])
    return h
