"""Codes along a Hilbert curve of any number of dimensions (after Skilling, 2004), for whole columns at once."""

from __future__ import annotations

import numpy as np


def scaled(values: np.ndarray, valid: np.ndarray, low: float, high: float, bits: int) -> np.ndarray:
    """Values mapped evenly from [low, high] to 0 … 2^bits - 1; what isn't valid to 0."""
    span = max(float(high) - float(low), 1.0)
    at = (np.where(valid, values, low).astype(np.float64) - float(low)) / span * ((1 << bits) - 1)
    return np.clip(np.rint(at), 0, (1 << bits) - 1).astype(np.uint64)


def codes(axes: list[np.ndarray], bits: int) -> np.ndarray:
    """The position of each point on the curve; ``len(axes) * bits`` must be at most 63."""
    n = len(axes)
    if n * bits > 63:
        raise ValueError("too many bits for one code")
    x = [a.astype(np.uint64).copy() for a in axes]
    one = np.uint64(1)
    # Undo the excess work of the inverse transform, from the highest bit down.
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, np.uint64(0), (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
    # Gray code.
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        t ^= np.where((x[n - 1] & q) != 0, q - one, np.uint64(0))
    for i in range(n):
        x[i] ^= t
    # The bits of all axes, interleaved from the highest.
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << one) | ((x[i] >> np.uint64(b)) & one)
    return out.astype(np.int64)
