"""Sets of word shingles, as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from basketry.llm.common import WordHasher, combine


def shingle_set(words: np.ndarray, n: int) -> np.ndarray:
    """Distinct shingles of n word hashes; a shorter text is one shingle, an empty one none."""
    if not len(words):
        return np.empty(0, np.uint64)
    n = min(n, len(words))
    return np.unique(combine(words[i:len(words) - n + 1 + i] for i in range(n)))


class Shingler:
    def __init__(self, n: int):
        self.n, self.hasher = n, WordHasher()

    def __call__(self, text: str | None) -> np.ndarray:
        return shingle_set(self.hasher(text), self.n)
