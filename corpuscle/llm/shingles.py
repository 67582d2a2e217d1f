"""Words and word shingles of whole texts as 64-bit numbers, for the operators that compare or count them."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hashes a task remembers; beyond it starts anew.
MEMO = 500_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x2545F4914F6CDD1D, 0x9FB21C651E98DF25], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def runs(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` in order."""
    n = len(hashes) - k + 1
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total += hashes[j : j + n] * _ODD[j % len(_ODD)] ** np.uint64(1 + j // len(_ODD))
    return mixed(total)


class Hashes(dict):
    """Word to 64-bit hash; an unknown word is hashed and remembered when it is first asked for."""

    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


class Words:
    """Texts to word hashes. A-Z are lower-cased; words are runs of bytes other than ASCII white space."""

    def __init__(self) -> None:
        self.memo = Hashes()

    def hashes(self, text: bytes | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint64)
        if len(self.memo) > MEMO:
            self.memo.clear()
        words = text.lower().split()
        return np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))

    def shingles(self, text: bytes | None, k: int) -> np.ndarray:
        """Sorted distinct hashes of the text's ``k``-word runs; of fewer words the whole sequence; else none."""
        h = self.hashes(text)
        if not len(h):
            return h
        return np.unique(runs(h, k) if len(h) >= k else runs(np.r_[h, np.uint64(len(h))], len(h) + 1))
