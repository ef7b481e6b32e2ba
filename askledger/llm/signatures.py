"""HyperMinHash signatures of word-shingle sets, and what is derived from them, in numpy.

The set of a text is that of its distinct shingles, held as 64-bit hashes. The top 8 bits of a hash choose one of 256
buckets; of each bucket's smallest remaining value the register keeps the number of leading zeros and the ten bits after
the first one: 16 bits for what takes 56. Zero means an empty bucket.
"""

from __future__ import annotations

import numpy as np

from askledger.llm.words import mixed

SHINGLE = 5
BUCKETS = 256
MANTISSA = 10
ROWS = 5
BANDS = BUCKETS // ROWS
#: Fixed value: the constant of the collision estimate for such registers.
CHANCE = 0.169919487
_REST = 56
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_ATTEMPTS = 24


def shingle_set(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of all runs of `size` words; of the whole sequence if it is shorter; empty without words."""
    n = len(words)
    if not n:
        return words
    width = min(size, n)
    h = np.full(n - width + 1, np.uint64(width))
    for k in range(width):
        h = h * _SPREAD + words[k : n - width + 1 + k]
    return np.unique(mixed(h))


def digest(hashes: np.ndarray) -> tuple[int, int]:
    """Two 64-bit numbers that stand for a whole set."""
    import xxhash

    d = xxhash.xxh3_128_intdigest(hashes.tobytes())
    return (d >> 64) - (1 << 63), (d & (1 << 64) - 1) - (1 << 63)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of registers for each set."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    for row, hashes in zip(out, sets, strict=True):
        bucket = hashes >> np.uint64(_REST)
        first = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(hashes) else []
        rest = (hashes[first] << np.uint64(64 - _REST)) >> np.uint64(64 - _REST) if len(first) else hashes
        # 53 of the 56 bits are exact in a double; its exponent then counts the leading zeros
        mantissa, exponent = np.frexp((rest >> np.uint64(3)).astype(np.float64))
        zeros = (_REST - 3 - exponent).astype(np.uint16)
        bits = np.where(mantissa > 0, np.floor((mantissa - 0.5) * (2 << MANTISSA)), 0).astype(np.uint16)
        if len(first):
            row[bucket[first].astype(np.int64)] = (zeros << np.uint16(MANTISSA)) + bits + np.uint16(1)
    return out


def _probe_order() -> np.ndarray:
    """For each bucket, the buckets to borrow from, in turn: fixed, alike in every process."""
    k = np.arange(BUCKETS * _ATTEMPTS, dtype=np.uint64)
    return (mixed((k + np.uint64(1)) * _SPREAD) >> np.uint64(56)).astype(np.int64).reshape(BUCKETS, _ATTEMPTS)


PROBE_ORDER = _probe_order()


def filled(regs: np.ndarray) -> np.ndarray:
    """Registers with every empty bucket lent the value of another: a few tries at fixed random places, then the next
    that is not empty. Two sets alike borrow alike, so sets with few shingles can be banded too."""
    out = regs.copy()
    for k in range(_ATTEMPTS):
        row, bucket = np.nonzero(out == 0)
        if not len(row):
            return out
        out[row, bucket] = regs[row, PROBE_ORDER[bucket, k]]
    row, bucket = np.nonzero(out == 0)
    if len(row):
        twice = np.concatenate((regs, regs), axis=1)
        place = np.where(twice > 0, np.arange(2 * BUCKETS), 2 * BUCKETS - 1)
        following = np.minimum.accumulate(place[:, ::-1], axis=1)[:, ::-1]
        out[row, bucket] = twice[row, following[row, bucket]]
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band of ROWS compressed registers."""
    part = filled(regs)[:, : BANDS * ROWS].reshape(len(regs), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(regs), BANDS)).copy()
    for k in range(ROWS):
        key = mixed(key * _SPREAD + part[:, :, k])
    return key.view(np.int64)


def estimated_jaccard(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Share of equal registers among buckets that either set fills, less the share expected to be equal by chance.

    Two unrelated buckets' minima fall into the same interval of one leading-zero count and one mantissa with probability
    about CHANCE / 2^MANTISSA times 4ab / (a+b)^2 for set sizes a and b.
    """
    either = ((a > 0) | (b > 0)).sum(1)
    equal = ((a == b) & (a > 0)).sum(1)
    chance = CHANCE / (1 << MANTISSA) * 4.0 * size_a * size_b / np.maximum(size_a + size_b, 1) ** 2
    return (equal / np.maximum(either, 1) - chance) / (1 - chance)
