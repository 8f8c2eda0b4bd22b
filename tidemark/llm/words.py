"""Words of whole texts as 64-bit hashes, for tasks that work on numpy arrays."""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

MAX_WORDS = 300_000


class WordHashes(dict):
    """Hash of a word (bytes), kept while the task sees it again; bounded by ``trim``."""

    def __missing__(self, word: bytes) -> int:
        self[word] = out = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return out

    def trim(self) -> None:
        if len(self) > MAX_WORDS:
            self.clear()

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


@lru_cache(maxsize=1)
def word_hashes() -> WordHashes:
    return WordHashes()


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain constants)."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def rolling(hashes: np.ndarray, width: int, seed: int = 1) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words."""
    n = max(0, len(hashes) - width + 1)
    out = np.zeros(n, dtype=np.uint64)
    weights = mix(np.arange(seed, seed + width, dtype=np.uint64)) | np.uint64(1)
    for j in range(width):
        out += hashes[j : j + n] * weights[j]
    return mix(out)


def in_slices(items: list, size, limit: int):
    """Split a batch so that no slice holds much more than ``limit`` of what ``size`` measures."""
    held, total = [], 0
    for item in items:
        held.append(item)
        total += size(item)
        if total >= limit:
            yield held
            held, total = [], 0
    if held:
        yield held
