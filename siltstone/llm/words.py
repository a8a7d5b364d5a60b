"""Words of a text as arrays: splitting, hashing and mixing with NumPy, one text at a time.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage
return, which is what ``bytes.split()`` yields. All sums wrap modulo 2**64.
"""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, np.ndarray] = {}


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit values (a bijection)."""
    with np.errstate(over="ignore"):
        x = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for ``i`` below ``n``; tables up to one block are kept."""
    table = _POWERS.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, 1024), base, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if n <= 2 * BLOCK:
            _POWERS[base] = table
    return table[:n]


def rolling(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """Polynomial hash of every run of ``width`` values, in order of its start."""
    n = len(values)
    if n < width:
        return np.empty(0, dtype=np.uint64)
    inverse = pow(base, -1, 1 << 64)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, n), out=total[1:])
    return mix((total[width:] - total[:-width]) * powers(inverse, n - width + 1))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word of a UTF-8 text, in order; long texts go block by block."""
    parts, start = [], 0
    while start < len(data):
        stop = start + BLOCK
        while stop < len(data) and not data[stop : stop + 1].isspace():
            stop += 1
        parts.append(_hash_block(data[start:stop]))
        start = stop
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)


def _hash_block(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, dtype=np.uint8)
    solid = np.zeros(len(raw) + 2, dtype=np.int8)
    solid[1:-1] = (raw != 32) & ((raw < 9) | (raw > 13))
    edges = np.diff(solid)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(_BASE, len(raw)), out=total[1:])
    back = powers(pow(_BASE, -1, 1 << 64), len(raw))
    return mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
