"""Word shingles as 64-bit hashes. Words are what ASCII white space separates, with A-Z lower-cased."""

from __future__ import annotations

import numpy as np
import xxhash

_KEPT = 200_000


class WordHashes(dict):
    """64-bit hash of each word seen."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        self[word] = value
        return value


_HASHES = WordHashes()


def word_hashes(text: str) -> np.ndarray:
    """One hash per word, in order."""
    if len(_HASHES) > _KEPT:
        _HASHES.clear()
    words = text.encode("utf-8", "surrogatepass").lower().split()
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def scramble(values: np.ndarray) -> np.ndarray:
    """A fixed one-to-one mixing of 64-bit numbers."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0xD6E8FEB86659FD93)
    return values ^ (values >> np.uint64(32))


def windows(words: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of ``width`` words; none if there are fewer."""
    n = len(words) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(width):
        total = total * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n]
    return scramble(total)


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """The distinct shingles; fewer words than ``width`` are one shingle together, no word none."""
    return np.unique(windows(words, min(width, len(words)))) if len(words) else np.zeros(0, np.uint64)
