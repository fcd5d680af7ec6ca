"""Shingle sets of texts as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = np.cumprod(np.full(64, _BASE, dtype=np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str) -> np.ndarray:
    """Hashes of the words of text (runs of anything but ASCII white space), A-Z in lower case."""
    global _powers
    raw = np.frombuffer(text.encode().lower(), dtype=np.uint8)
    at = np.flatnonzero(~_SPACE[raw])
    if not len(at):
        return np.zeros(0, dtype=np.uint64)
    starts = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    lengths = np.diff(np.concatenate((starts, [len(at)])))
    if (longest := int(lengths.max())) > len(_powers):
        _powers = np.cumprod(np.full(2 * longest, _BASE, dtype=np.uint64))
    inside = np.arange(len(at)) - np.repeat(starts, lengths)
    sums = np.add.reduceat((raw[at].astype(np.uint64) + np.uint64(1)) * _powers[inside], starts)
    return mix(sums ^ lengths.astype(np.uint64))


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of all runs of n words; of the whole text if it has fewer words; empty without words."""
    words = word_hashes(text or "")
    if not len(words):
        return words
    k = min(n, len(words))
    count = len(words) - k + 1
    folded = np.full(count, np.uint64(k), dtype=np.uint64)
    for i in range(k):
        folded = mix(folded * _BASE + words[i : i + count])
    return np.unique(folded)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted arrays of distinct values."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0
