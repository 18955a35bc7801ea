"""Numbers of seven bits a byte, written and read as whole arrays; the last byte is below 128."""

from __future__ import annotations

import numpy as np


def encode(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, place behind each value) of unsigned numbers."""
    values = values.astype(np.uint64, copy=False)
    sizes = np.ones(len(values), np.int64)
    for shift in range(7, 64, 7):
        more = values >= np.uint64(1 << shift)
        if not more.any():
            break
        sizes += more
    ends = np.cumsum(sizes)
    starts = ends - sizes
    made = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    for n in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > n) if n else slice(None)
        low = (values[on] >> np.uint64(7 * n)).astype(np.uint8) & 127
        made[starts[on] + n] = low | ((sizes[on] > n + 1).astype(np.uint8) << 7)
    return made, ends


def decode(data: np.ndarray) -> np.ndarray:
    """The numbers that an array of bytes holds."""
    ends = np.flatnonzero(data < 128)
    starts = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    sizes = ends - starts + 1
    values = np.zeros(len(ends), np.uint64)
    for n in range(int(sizes.max(initial=0))):
        on = np.flatnonzero(sizes > n) if n else slice(None)
        values[on] |= (data[starts[on] + n] & 127).astype(np.uint64) << np.uint64(7 * n)
    return values
