"""Hashes of all stretches of bytes, from one pass of sums."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
#: Powers made at once at least.
LEAST = 5 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit number for each number."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(base: int, n: int) -> np.ndarray:
    factors = np.full(n + 1, base, np.uint64)
    factors[0] = 1
    return np.cumprod(factors)


class _Powers:
    """Powers of the base and its inverse, as many as the longest data needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            n = max(n, LEAST)
            self.up, self.down = _powers(BASE, n), _powers(INVERSE, n)
        return self.up, self.down


_POWERS = _Powers()


class Rolling:
    """Hashes of stretches of some bytes; equal stretches have equal hashes."""

    def __init__(self, data: np.ndarray):
        up, self.down = _POWERS.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        terms = data.astype(np.uint64)
        terms += U(1)
        terms *= up[: len(data)]
        np.cumsum(terms, out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def of_length(self, k: int) -> np.ndarray:
        """Of every stretch of k bytes, by its start."""
        found = self.sums[k:] - self.sums[:-k]
        found *= self.down[: len(found)]
        return mixed(found)
