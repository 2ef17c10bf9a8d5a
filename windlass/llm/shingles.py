"""Word shingles as 64-bit hashes, the same in every process."""

from __future__ import annotations

import re

import numpy as np
import xxhash

WIDTH = 5
WORDS = re.compile("[^\x20\x09-\x0d]+").findall
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: list[str], width: int = WIDTH) -> np.ndarray:
    """One hash for each run of `width` words; none for fewer words."""
    hashes = word_hashes(words)
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(width):
        mixed = (mixed + hashes[k:k + n]) * _BASE
        mixed ^= mixed >> np.uint64(29)
    return mixed


def text_shingles(words: list[str], width: int = WIDTH) -> np.ndarray:
    """Distinct shingle hashes, ascending. A text of fewer words is one shingle."""
    if 0 < len(words) < width:
        return shingle_hashes(words, len(words))
    return np.unique(shingle_hashes(words, width))
