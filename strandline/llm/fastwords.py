"""Hashing of words, remembered between texts."""

from __future__ import annotations

from zlib import crc32

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)
SPREAD = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """word -> 64-bit hash. Holds `most` words at most; others are hashed each time."""

    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        value = crc32(raw) << 32 | crc32(raw, 0x5BD1E995)
        if len(self) < self.most and len(raw) <= 64:
            self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values, so that any bits of them can serve as buckets."""
    v = values * MIX
    v ^= v >> np.uint64(29)
    v *= SPREAD
    v ^= v >> np.uint64(32)
    return v


def n_grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """One hash for each run of n words."""
    size = max(0, len(hashes) - n + 1)
    out = mixed(hashes[:size] + np.uint64(n))
    for i in range(1, n):
        out = mixed(out ^ hashes[i : i + size])
    return out
