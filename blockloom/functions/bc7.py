"""Encoding to BC7's one-subset RGBA mode: seven-bit ends with a low bit of their own, four-bit indices."""

from __future__ import annotations

import numpy as np

from .blocks import WEIGHTS

_W = np.array(WEIGHTS[4])


def _quantise(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Seven-bit values, the shared low bit with the smaller error (0 on a tie), and the eight-bit ends they make."""
    found = []
    for p in (0, 1):
        q = np.clip((ends - p + 1) // 2, 0, 127)
        found.append((q, ((2 * q + p - ends) ** 2).sum(1)))
    p = (found[1][1] < found[0][1]).astype(np.int64)
    q = np.where(p[:, None] == 1, found[1][0], found[0][0])
    return q, p, 2 * q + p[:, None]


def _fit(px: np.ndarray, e0: np.ndarray, e1: np.ndarray) -> tuple[np.ndarray, ...]:
    q0, p0, a = _quantise(e0)
    q1, p1, b = _quantise(e1)
    entries = (a[:, None] * (64 - _W)[:, None] + b[:, None] * _W[:, None] + 32) >> 6
    d = ((px[:, :, None] - entries[:, None]) ** 2).sum(-1)
    index = d.argmin(2)
    error = np.take_along_axis(d, index[:, :, None], 2)[:, :, 0].sum(1)
    return q0, p0, q1, p1, index, error


def _better(old: tuple[np.ndarray, ...], new: tuple[np.ndarray, ...], allowed: np.ndarray | bool = True) -> tuple[np.ndarray, ...]:
    use = allowed & (new[-1] < old[-1])
    return tuple(np.where(use.reshape(-1, *[1] * (x.ndim - 1)), y, x) for x, y in zip(old, new, strict=True))


def encode_mode6(pixels: np.ndarray, rounds: int = 2) -> np.ndarray:
    """(n, 16, 4) uint8 to 16-byte blocks: seeds from the channels' extremes and from the darkest and brightest pixel, then least squares."""
    px = pixels.astype(np.int64)
    rows = np.arange(len(px))
    best = _fit(px, px.min(1), px.max(1))
    light = px @ np.array([2, 3, 1, 2])
    best = _better(best, _fit(px, px[rows, light.argmin(1)], px[rows, light.argmax(1)]))
    for _ in range(rounds):
        b = _W[best[4]] / 64
        a = 1 - b
        aa, bb, ab = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
        det = aa * bb - ab * ab
        safe = np.where(det > 1e-4, det, 1)[:, None]
        ax, bx = (a[:, :, None] * px).sum(1), (b[:, :, None] * px).sum(1)
        ends = [np.floor(e / safe + 0.5).clip(0, 255).astype(np.int64) for e in (bb[:, None] * ax - ab[:, None] * bx, aa[:, None] * bx - ab[:, None] * ax)]
        best = _better(best, _fit(px, *ends), det > 1e-4)
    q0, p0, q1, p1, index, _ = best
    turn = index[:, 0] > 7  # the first pixel's top bit is not stored
    q0, q1 = np.where(turn[:, None], q1, q0), np.where(turn[:, None], q0, q1)
    p0, p1 = np.where(turn, p1, p0), np.where(turn, p0, p1)
    index = np.where(turn[:, None], 15 - index, index)
    bits = np.zeros((len(px), 128), np.uint8)

    def put(at: int, n: int, v: np.ndarray) -> None:
        bits[:, at : at + n] = (v[:, None] >> np.arange(n)) & 1

    put(0, 7, np.full(len(px), 64))
    for c in range(4):
        put(7 + 14 * c, 7, q0[:, c])
        put(14 + 14 * c, 7, q1[:, c])
    put(63, 1, p0)
    put(64, 1, p1)
    put(65, 3, index[:, 0])
    for k in range(1, 16):
        put(64 + 4 * k, 4, index[:, k])
    return np.packbits(bits, axis=1, bitorder="little")
