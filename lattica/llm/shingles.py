"""Word shingles as 64-bit hashes, for whole texts."""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash

from lattica.llm.common import claim

#: Words whose hashes a worker keeps; the table is emptied when it is full.
CACHE_WORDS = 120_000
CACHE_BYTES = 64
_FOLD, _MIX1, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class WordHashes(dict):
    """Hash of a word's bytes, computed when first asked for; bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= CACHE_BYTES:
            self[word] = h
        return h


KNOWN = WordHashes()


def words_of(text: str | bytes | None) -> list[bytes]:
    """Runs of bytes other than ASCII white space, A-Z lower-cased."""
    if not text:
        return []
    data = text.encode() if isinstance(text, str) else text
    return data.lower().split()


def word_hashes(text: str | bytes | None) -> np.ndarray:
    claim("shingles", KNOWN.clear)
    words = words_of(text)
    return np.fromiter(map(KNOWN.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def run_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """The hash of each run of `size` words, by place; of the whole sequence where it is shorter; none where it is empty."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.uint64)
    size = min(size, n)
    with np.errstate(over="ignore"):
        out = np.full(n - size + 1, size, np.uint64)
        for k in range(size):
            out = out * _FOLD + hashes[k : n - size + 1 + k]
        return mixed(out)


def shingle_set(text: str | bytes | None, size: int) -> np.ndarray:
    """The distinct shingles' hashes in order, as signed integers."""
    return np.unique(run_hashes(word_hashes(text), size).view(np.int64))


def set_key(shingles: np.ndarray) -> bytes:
    """Names a set of shingles: 128 bits of its content."""
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()
