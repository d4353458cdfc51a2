"""Words and word shingles of a text as 64-bit hashes, inside a task."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words whose hashes a worker keeps.
CACHED_WORDS = 400_000

_MULTIPLIERS = np.random.default_rng(20240607).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _WordHashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    """Maximal runs of other bytes than ASCII white space, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of the ``k``-word shingles; of a text with fewer words the
    whole sequence is the one shingle; none without words."""
    w = words(text)
    if not w:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, w), np.uint64, len(w))
    k = min(k, len(w))
    n = len(w) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out += mix(h[i : i + n]) * _MULTIPLIERS[i]
    return np.unique(mix(out))
