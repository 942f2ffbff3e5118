"""Words, shingles and stable hashes for the text operators, in Arrow batches."""

from __future__ import annotations

import re

import numpy as np
import xxhash

#: Words are maximal runs of letters and digits, in lower case.
WORD = re.compile(r"[^\W_]+")
_MAX_VOCABULARY = 1_000_000


class WordHash:
    """64-bit hashes of words, the same in every process; remembers a bounded vocabulary."""

    def __init__(self) -> None:
        self.seen: dict[str, int] = {}

    def word(self, w: str) -> int:
        """Hash of a word that is not remembered yet."""
        return xxhash.xxh64_intdigest(w)

    def __call__(self, words: list[str]) -> np.ndarray:
        seen = self.seen
        try:
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))
        except KeyError:
            if len(seen) > _MAX_VOCABULARY:
                seen.clear()
            for w in words:
                if w not in seen:
                    seen[w] = self.word(w)
            return np.fromiter(map(seen.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[str]:
    """Lower-cased words of ``text``; none for null."""
    return WORD.findall(text.lower()) if text else []


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def shingles(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the sequences of ``k`` consecutive words, in order; one hash of all words where there are fewer than ``k`` and at least one."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : n - k + 1 + i]
    return mix(out, k)
