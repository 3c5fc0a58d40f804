"""64-bit FNV-1a and what is built on it."""

from __future__ import annotations

import numpy as np

# The hash's offset basis and prime.
OFFSET, PRIME = 0xCBF29CE484222325, 0x100000001B3
_MASK = (1 << 64) - 1


def fnv1a(data: bytes, seed: int = OFFSET) -> int:
    h = seed
    for b in data:
        h = (h ^ b) * PRIME & _MASK
    return h


def fnv1a_rows(rows: np.ndarray, seed: int = OFFSET) -> np.ndarray:
    """The hash of each row of (n, bytes) uint8, all rows a byte at a time."""
    h = np.full(len(rows), seed, np.uint64)
    for column in rows.T:
        h = (h ^ column.astype(np.uint64)) * np.uint64(PRIME)
    return h


def fold(values: list[int], seed: int = OFFSET) -> int:
    h = seed
    for v in values:
        h = fnv1a(v.to_bytes(8, "little"), h)
    return h


def combine(values: list[int]) -> int:
    """One hash of many whatever their order."""
    return fold(sorted(values))


def _turned(v: int, n: int) -> int:
    v &= _MASK
    return (v << n | v >> (64 - n)) & _MASK


# What the second to fourth lane start from.
LANES = (OFFSET, 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def bulk(data: bytes, seed: int = 0) -> int:
    """A hash of long data in four lanes of eight bytes; what is left of 32 bytes goes byte by byte."""
    lanes = [_turned(seed, 16 * i) ^ start for i, start in enumerate(LANES)]
    whole = len(data) // 32
    for row in np.frombuffer(data, "<u8", 4 * whole).reshape(-1, 4).tolist():
        lanes = [(lane ^ w) * PRIME & _MASK for lane, w in zip(lanes, row, strict=True)]
    h = lanes[0] ^ _turned(lanes[1], 17) ^ _turned(lanes[2], 34) ^ _turned(lanes[3], 51)
    return fnv1a(data[32 * whole :], (h * PRIME & _MASK) ^ len(data))
