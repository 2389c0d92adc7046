"""Small per-task text helpers shared by the operators: words, hashes, shingles."""

from __future__ import annotations

import numpy as np
import xxhash

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x = x ^ (x >> np.uint64(27))
    x = x * _M2
    return x ^ (x >> np.uint64(31))


class HashCache(dict):
    """Word bytes to a 64-bit hash. Emptied when it reaches ``limit`` entries, so memory stays bounded."""

    def __init__(self, limit: int = 300_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def ascii_lower_words(text: str | None) -> list[bytes]:
    """Lower-case A-Z and split at ``[\\x20\\x09-\\x0D]+``; other characters stay as they are."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(words: list[bytes], k: int, cache: HashCache) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; a shorter sequence counts as one shingle."""
    n = len(words)
    if not n:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=n)
    if n < k:
        total = np.uint64(n)
        for i, v in enumerate(h):
            total = mix64(np.array([total ^ v], dtype=np.uint64) * _ODD[i % len(_ODD)])[0]
        return np.array([total], dtype=np.uint64)
    acc = h[: n - k + 1] * _ODD[0]
    for i in range(1, k):
        acc = mix64(acc) + h[i : n - k + 1 + i] * _ODD[i % len(_ODD)]
    acc = np.sort(mix64(acc))
    return acc[np.concatenate(([True], acc[1:] != acc[:-1]))]
