"""Word shingles of texts as sets of numbers, and their similarity."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE_WORDS = 5

_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def words_of(text: str | None) -> list[bytes]:
    """Runs without ASCII blanks, A-Z lower-cased, as for fingerprints."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Numbers of the different word shingles of a text; a shorter text is one shingle, one without words has none."""
    w = words_of(text)
    if not w:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, w), dtype=np.uint64, count=len(w))
    n = min(words, len(w))
    made = np.full(len(w) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        made = made * _STEP + h[k : len(h) - n + 1 + k]
    made = (made ^ (made >> np.uint64(32))) * _MIX
    return np.unique(made ^ (made >> np.uint64(29)))


def similarity(a: str | None, b: str | None, words: int = SHINGLE_WORDS) -> float:
    """The share of all different shingles of two texts that both hold; 0 for a text without words."""
    x, y = shingles(a, words), shingles(b, words)
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both / max(len(x) + len(y) - both, 1)
