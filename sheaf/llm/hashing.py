"""Hashes of many byte ranges at once.

Bytes are replaced by random 64-bit values and summed up with powers of an odd number, so that the hash of any
range is a difference of two prefix sums, scaled; a finaliser spreads the bits. Equal ranges have equal hashes everywhere.
"""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
BLOCK = 1 << 22


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 64, 256, np.uint64)


_TABLES = [_table(7), _table(11)]


def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


_up, _down = _powers(_BASE, 1 << 16), _powers(_INVERSE, 1 << 16)


def _grow(n: int) -> None:
    global _up, _down
    if len(_up) <= n:
        size = max(n, 2 * len(_up))
        _up, _down = _powers(_BASE, size), _powers(_INVERSE, size)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ x >> np.uint64(33)


def range_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """64-bit hashes of ``data[starts:ends]`` (uint8), ``which`` chooses one of two independent functions."""
    _grow(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLES[which][data] * _up[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * _down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
