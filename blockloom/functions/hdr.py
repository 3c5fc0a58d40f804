"""High-dynamic-range blocks: unsigned one-subset blocks with 10-bit ends, encoded in the domain of half patterns."""

from __future__ import annotations

import numpy as np

from .blocks import WEIGHTS

_W = np.array(WEIGHTS[4])


def to_half(values: np.ndarray) -> np.ndarray:
    """Half patterns of floats, halves rounded up; what is negative or no number is 0, what is too large the largest finite one."""
    v = np.nan_to_num(values.astype(np.float32), nan=0.0, posinf=65504.0, neginf=0.0).clip(0, 65504)
    normal = (v.view(np.uint32).astype(np.int64) - (112 << 23) + 0x1000) >> 13
    tiny = np.where(v < 2.0**-24, 0, np.floor(v.astype(np.float64) * 2.0**24 + 0.5)).astype(np.int64)
    return np.minimum(np.where(v < 2.0**-14, tiny, normal), 0x7BFF)


def _wide(q: np.ndarray) -> np.ndarray:
    return np.where(q == 0, 0, np.where(q == 1023, 0xFFFF, ((q << 16) + 0x8000) >> 10))


def _quantise(half: np.ndarray) -> np.ndarray:
    """The 10-bit end whose own half pattern is nearest, of those around a thirty-first."""
    tries = np.clip(half[..., None] // 31 + np.arange(-2, 3), 0, 1023)
    error = (((_wide(tries) * 31) >> 6) - half[..., None]) ** 2
    return np.take_along_axis(tries, error.argmin(-1)[..., None], -1)[..., 0]


def _fit(half: np.ndarray, e0: np.ndarray, e1: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    q0, q1 = _quantise(e0), _quantise(e1)
    a, b = _wide(q0)[:, None], _wide(q1)[:, None]
    entries = (((a * (64 - _W)[:, None] + b * _W[:, None] + 32) >> 6) * 31) >> 6
    d = ((half[:, :, None] - entries[:, None]) ** 2).sum(-1)
    index = d.argmin(2)
    error = np.take_along_axis(d, index[:, :, None], 2)[:, :, 0].sum(1)
    turn = index[:, 0] > 7  # the first pixel's top bit is not stored
    index = np.where(turn[:, None], 15 - index, index)
    return np.where(turn[:, None], q1, q0), np.where(turn[:, None], q0, q1), index, error


def encode_bc6h(pixels: np.ndarray) -> np.ndarray:
    """(n, 16, 3 or 4) floats to 16-byte blocks: the channels' extremes, then one least-squares round if it is better."""
    half = to_half(pixels[:, :, :3])
    q0, q1, index, error = _fit(half, half.max(1), half.min(1))
    b = _W[index] / 64
    a = 1 - b
    aa, bb, ab = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
    det = aa * bb - ab * ab
    safe = np.where(det > 1e-4, det, 1)[:, None]
    ax, bx = (a[:, :, None] * half).sum(1), (b[:, :, None] * half).sum(1)
    ends = [np.floor(e / safe + 0.5).clip(0, 0x7BFF).astype(np.int64) for e in (bb[:, None] * ax - ab[:, None] * bx, aa[:, None] * bx - ab[:, None] * ax)]
    other = _fit(half, *ends)
    better = (det > 1e-4) & (other[3] < error)
    q0, q1, index = (np.where(better[:, None], new, old) for new, old in zip(other, (q0, q1, index), strict=False))
    bits = np.zeros((len(half), 128), np.uint8)
    put = lambda at, n, v: bits.__setitem__((slice(None), slice(at, at + n)), (v[:, None] >> np.arange(n)) & 1)
    put(0, 5, np.full(len(half), 3))
    for c in range(3):
        put(5 + 10 * c, 10, q0[:, c])
        put(35 + 10 * c, 10, q1[:, c])
    put(65, 3, index[:, 0])
    for p in range(1, 16):
        put(64 + 4 * p, 4, index[:, p])
    return np.packbits(bits, axis=1, bitorder="little")


def log_psnr(a: np.ndarray, b: np.ndarray, stops: float = 36.0) -> float:
    """Peak signal-to-noise ratio of log2 values against a range of stops."""
    low = 2.0**-24
    error = ((np.log2(np.maximum(a, low)) - np.log2(np.maximum(b, low))) ** 2).mean()
    return float("inf") if error == 0 else float(10 * np.log10(stops**2 / error))
