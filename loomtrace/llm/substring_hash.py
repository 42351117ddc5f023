"""Numpy helpers on bytes: polynomial hashes of any range, and a cover sample of positions."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Bytes hashed at once; positions in a block fit 20 bits.
BLOCK = 1 << 20
FACTOR = 0x9E3779B97F4A7C15
MIX = np.uint64(0xD6E8FEB86659FD93)


@lru_cache(maxsize=1)
def constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, and the powers of FACTOR and of its inverse modulo 2^64."""
    random = np.random.default_rng(5).integers(1, 1 << 64, 256, dtype=np.uint64)
    power = np.full(BLOCK + 1, np.uint64(FACTOR))
    inverse = np.full(BLOCK + 1, np.uint64(pow(FACTOR, -1, 1 << 64)))
    power[0] = inverse[0] = 1
    return random, np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(32))


class Hashes:
    """Hashes of ranges of data, at most BLOCK bytes: equal ranges have equal hashes wherever they stand."""

    def __init__(self, data: np.ndarray):
        random, power, self.inverse = constants()
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(random[data] * power[: len(data)], out=self.sums[1:])

    def all_of(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        return mixed((self.sums[length:] - self.sums[:n]) * self.inverse[:n]) if n > 0 else np.zeros(0, dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64) * MIX)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    n, have = len(values) - width + 1, 1
    if n <= 0:
        return values[:0]
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[:n], values[width - have : width - have + n])


def anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each `width` hashes in a row the place of the least (of equal ones the first): places depend on content alone."""
    places = np.arange(len(hashes), dtype=np.uint64)
    least = least_of((hashes & ~np.uint64(BLOCK - 1)) | places, width)
    return (least & np.uint64(BLOCK - 1)).astype(np.int64)
