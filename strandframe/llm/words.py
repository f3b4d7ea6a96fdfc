"""Words and word hashes of whole texts inside Arrow batches (pure helpers for tasks)."""

from __future__ import annotations

import numpy as np
import xxhash

MIX_A = np.uint64(0x9E3779B97F4A7C15)
MIX_B = np.uint64(0xC2B2AE3D27D4EB4F)


def split_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Maximal runs without space or \\x09-\\x0D; ``lower`` folds A-Z only.  Null and empty texts have none."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


class WordHash(dict):
    """word -> 64-bit hash, kept for the words of one batch."""

    def __init__(self, seed: int = 0):
        super().__init__()
        self.seed = seed

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word, self.seed)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


class WordIndex(dict):
    """word -> its number, kept for the words of one batch, so that several hashes need one look-up of each word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))

    def hashes(self, seed: int) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in self), np.uint64, len(self))


def scramble(x: np.ndarray) -> np.ndarray:
    """Bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of every run of ``n`` word hashes, by its start; doubling keeps it O(log n) passes."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    acc, have = None, 0
    power, width = scramble(h + np.uint64(salt)), 1
    rest = n
    while rest:
        if rest & 1:
            if acc is None:
                acc, have = power, width
            else:
                m = len(h) - have - width + 1
                acc = scramble(acc[:m] * MIX_A + power[have : have + m] * MIX_B + np.uint64(have))
                have += width
        rest >>= 1
        if rest:
            m = len(h) - 2 * width + 1
            power = scramble(power[:m] * MIX_A + power[width : width + m] * MIX_B + np.uint64(width))
            width *= 2
    return acc[: len(h) - n + 1]


def shingle_set(words: list[bytes], n: int, cache: WordHash) -> np.ndarray:
    """Sorted distinct hashes of ``n``-word shingles; a shorter text is one shingle; no words: empty."""
    if not words:
        return np.empty(0, np.uint64)
    h = cache.of(words)
    return np.unique(grams(h, min(n, len(words))))
