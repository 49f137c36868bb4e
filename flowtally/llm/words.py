"""Words of byte arrays, cut and hashed as whole arrays."""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that is far from linear."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(seed: int) -> tuple[np.ndarray, np.uint64, np.uint64]:
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 63, 258, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a[:256], a[256], a[257]


def word_edges(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the runs without ASCII white space."""
    edge = np.flatnonzero(np.diff(np.concatenate([[True], SPACE[data], [True]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """64-bit hash of each word ``data[start:end]``."""
    symbol, base, _ = constants(seed)
    size = end - start
    power = np.full(int(size.max()), base, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    at = np.concatenate([[0], np.cumsum(size)[:-1]])
    within = np.arange(int(size.sum())) - np.repeat(at, size)
    flat = symbol[data[np.repeat(start, size) + within]] * power[within]
    return mix(np.add.reduceat(flat, at) + size.astype(np.uint64))


def in_sorted(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(table, values), len(table) - 1)
    return table[at] == values
