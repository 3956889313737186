"""Words and their hashes, for operators whose core runs in numpy inside Spark tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd 64-bit multipliers of the mixing functions.
MIX_A = np.uint64(0xBF58476D1CE4E5B9)
MIX_B = np.uint64(0x94D049BB133111EB)
STEP = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHash(dict):
    """Word to 64-bit hash. Holds a bounded number of words and starts anew beyond it."""

    def __init__(self, most: int = 200_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` consecutive words; empty if there are fewer."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.empty(0, np.uint64)
    out = mix(hashes[:size] + STEP)
    for k in range(1, n):
        out = mix(out * MIX_B + hashes[k : k + size])
    return out
