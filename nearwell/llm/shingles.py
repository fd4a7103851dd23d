"""Word shingles of whole texts as 64-bit hashes, computed on Arrow buffers with numpy."""

from __future__ import annotations

import numpy as np

from .common import mix64

WORDS = 5
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_K = np.random.default_rng(5).integers(1, 2**63, WORDS + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
KEPT = (1 << 19) + 4096  # powers that a worker keeps: enough for a slice of texts
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i up to n; kept up to KEPT entries."""
    if len(_powers[0]) <= n:
        size = max(n + 1, KEPT)
        made = []
        for base in (_BASE, _INVERSE):
            x = np.full(size, base, np.uint64)
            x[0] = 1
            made.append(np.cumprod(x, dtype=np.uint64))
        if size > KEPT:
            return made[0], made[1]
        _powers[:] = made
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (A-Z lower-cased, split at ASCII white space) and, per text, the index of its first word.

    A word's hash is its polynomial value modulo 2**64, taken from prefix sums and made independent of the place by the inverse power.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    full = offsets[1:] > offsets[:-1]
    first, last = offsets[:-1][full], offsets[1:][full] - 1
    starts[first] = inside[first]
    ends[last] = inside[last]
    s, e = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    up, down = powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    h = (sums[e] - sums[s]) * down[s]
    return mix64(h + (e - s).astype(np.uint64) * _K[0]), np.searchsorted(s, offsets)


def shingle_hashes(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All shingles of WORDS words of every text, in order, and per text the index of its first one.

    A text of fewer words has its whole sequence as its only shingle; a text without words has none.
    """
    n = np.diff(first)
    count = np.where(n >= WORDS, n - WORDS + 1, np.minimum(n, 1))
    at = np.concatenate(([0], np.cumsum(count)))
    out = np.empty(at[-1], np.uint64)
    if len(words) >= WORDS:
        size = len(words) - WORDS + 1
        x = words[:size] * _K[1]
        for j in range(1, WORDS):
            x += words[j : j + size] * _K[j + 1]
        # a window is whole if it ends within the text of its first word
        text = np.repeat(np.arange(len(n)), n)[:size]
        whole = np.arange(size) + WORDS <= first[1:][text]
        long = np.repeat(n >= WORDS, count)
        out[long] = mix64(x[whole])
    for k in np.flatnonzero((n > 0) & (n < WORDS)):
        w = words[first[k] : first[k + 1]]
        x = (w * _K[1 : len(w) + 1]).sum(keepdims=True, dtype=np.uint64)
        out[at[k]] = mix64(x + np.full(1, len(w), np.uint64) * _K[0])[0]
    return out, at


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted set of shingles of every text."""
    g, at = shingle_hashes(*word_hashes(data, offsets))
    out = []
    for k in range(len(at) - 1):
        x = np.sort(g[at[k] : at[k + 1]])
        out.append(x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) > 1 else x)
    return out
