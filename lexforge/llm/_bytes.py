"""Vectorised hashing of runs and windows in many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """1, base, base**2, ... modulo 2**64; at least ``n`` of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= 1 << 21:  # longer ones are made anew for the few texts that need them
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int, fold: bool) -> np.ndarray:
    """A random 64-bit number for each byte; with ``fold``, the same for A-Z and a-z."""
    table = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if fold:
        table[65:91] = table[97:123]
    return table


class Rolling:
    """Hashes of any substring of ``data``, each from two prefix sums."""

    def __init__(self, data: np.ndarray, table: np.ndarray):
        n = len(data)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(table[data] * powers(_BASE, n)[:n], dtype=np.uint64, out=self.sums[1:])
        self.back = powers(_INVERSE, n + 1)

    def at(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Unmixed hashes of data[start:end]; equal for equal strings wherever they stand."""
        return (self.sums[end] - self.sums[start]) * self.back[start]


def groups(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours with a total size of at most ``most``, a larger one alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def runs(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    return edge[::2], edge[1::2]
