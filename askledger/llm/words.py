"""Words of texts as 64-bit numbers, in bulk: A-Z lower-cased, cut at the six ASCII space characters."""

from __future__ import annotations

import numpy as np
import xxhash

CACHE_WORDS = 200_000

_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection: nothing collides here)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """bytes of a word -> its hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words one text after the other, and the number of words of each text."""
        if len(self) > CACHE_WORDS:
            self.clear()
        words: list[int] = []
        counts = np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            if text:
                before = len(words)
                words += map(self.__getitem__, text.encode().lower().split())
                counts[k] = len(words) - before
        return np.array(words, np.uint64), counts
