"""Positions on a Hilbert curve, for many points at once."""

from __future__ import annotations

import numpy as np


def positions(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place along the curve of each row of integer coordinates in [0, 2 ** bits).

    The rows of ``cells`` are points; dimensions * bits must stay below 64. From the highest bit
    down, the axes of the current cube are reflected and exchanged as the curve turns; the bits
    that remain, read across axes as a Gray code, are the place.
    """
    x = np.array(cells, np.uint64).T.copy()
    axes, one = len(x), np.uint64(1)
    level = one << np.uint64(bits - 1)
    while level > 1:
        low = level - one
        for axis in range(axes):
            turned = (x[axis] & level) != 0
            swap = np.where(turned, np.uint64(0), (x[0] ^ x[axis]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[axis] ^= swap
        level >>= one
    for axis in range(1, axes):
        x[axis] ^= x[axis - 1]
    level, flip = one << np.uint64(bits - 1), np.zeros(x.shape[1], np.uint64)
    while level > 1:
        flip ^= np.where((x[-1] & level) != 0, level - one, np.uint64(0))
        level >>= one
    x ^= flip
    place = np.zeros(x.shape[1], np.uint64)
    for bit in range(bits - 1, -1, -1):
        for axis in range(axes):
            place = place << one | (x[axis] >> np.uint64(bit) & one)
    return place.astype(np.int64)
