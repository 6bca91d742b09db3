"""Rolling hashes and sliding extremes over arrays: the small numeric helpers of the substring operators."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse modulo 2^64, for i < n."""
    if len(_POWERS.get("up", ())) < n:
        size = max(n, 1 << 14)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def gram_hashes(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values (none if there are fewer)."""
    n = len(values)
    if n < k:
        return np.empty(0, np.uint64)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    return mixed((sums[k:] - sums[:-k]) * down[: n - k + 1])


def slide(x: np.ndarray, width: int, best: np.ufunc = np.minimum) -> np.ndarray:
    """best (minimum or maximum) of each window of `width` values, by doubling."""
    n, span = len(x) - width + 1, 1
    if n <= 0:
        return x[:0]
    while span * 2 <= width:
        x = best(x[:-span], x[span:])
        span *= 2
    return best(x[:n], x[width - span : width - span + n])


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of equal values."""
    if not len(x):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    cut = np.flatnonzero(x[1:] != x[:-1])
    return np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(x) - 1]])
