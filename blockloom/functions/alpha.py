"""Search of single-channel blocks: ends from several seeds, least squares, then the neighbourhood of the best.

All blocks of a batch go through the search together; a block takes part in a step only while its
error is worth it.  Signed blocks have signed ends, but errors are counted in unsigned values, as
their pixels are given.
"""

from __future__ import annotations

import numpy as np

from .palette import W4, W6

#: Distinct values up to which all ordered pairs of them are tried as ends.
FEW = 5
_TO_SNORM = np.clip((np.arange(256) * 253 + 127) // 254 - 127, -127, 127)
_TO_UNORM = ((np.arange(-127, 128) + 127) * 255 + 127) // 254
# Each index's share of the second end in the six-step palette, in sevenths.
_SHARE = np.array([0, 7, 1, 2, 3, 4, 5, 6], np.float32) / np.float32(7)


def to_snorm(values: np.ndarray) -> np.ndarray:
    return _TO_SNORM[values]


def to_unorm(values: np.ndarray) -> np.ndarray:
    return _TO_UNORM[np.clip(values, -127, 127) + 127]


def entries(e0: np.ndarray, e1: np.ndarray, signed: bool) -> np.ndarray:
    """The eight palette values of each pair of ends, in unsigned values."""
    low, high = (-127, 127) if signed else (0, 255)
    mix = lambda ws: [e0 + ((w * (e1 - e0) + 32768) >> 16) for w in ws]
    flat = np.zeros_like(e0)
    out = np.where((e0 > e1)[:, None], np.stack([e0, e1, *mix(W6)], 1), np.stack([e0, e1, *mix(W4), flat + low, flat + high], 1))
    return to_unorm(out) if signed else out


class Search:
    """The best ends of each block so far, with their indices and errors."""

    def __init__(self, values: np.ndarray, signed: bool):
        self.values, self.signed = values.astype(np.int64), signed
        self.low, self.high = (-127, 127) if signed else (0, 255)
        self.ends = self._own(self.values)
        n = len(values)
        self.e0, self.e1 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.index, self.error = np.zeros((n, 16), np.int64), np.full(n, np.iinfo(np.int64).max)

    def _own(self, values: np.ndarray) -> np.ndarray:
        return to_snorm(values) if self.signed else values

    def consider(self, rows: np.ndarray, e0: np.ndarray, e1: np.ndarray) -> None:
        """Take these ends for the blocks where they are better."""
        if not len(rows):
            return
        d = (self.values[rows][:, :, None] - entries(e0, e1, self.signed)[:, None]) ** 2
        index = d.argmin(2)
        error = np.take_along_axis(d, index[:, :, None], 2)[:, :, 0].sum(1)
        better = error < self.error[rows]
        own = rows[better]
        self.e0[own], self.e1[own], self.index[own], self.error[own] = e0[better], e1[better], index[better], error[better]

    def both(self, rows: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        self.consider(rows, a, b)
        self.consider(rows, b, a)

    def least_squares(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which rows have new ends, and these: for six-step palettes only, whose entries all move with the ends."""
        rows = rows[self.e0[rows] > self.e1[rows]]
        w = _SHARE[self.index[rows]]
        x = self.ends[rows].astype(np.float32)
        n, sw, sww, sx, sxw = np.float32(16), w.sum(1), (w * w).sum(1), x.sum(1), (x * w).sum(1)
        det = n * sww - sw * sw
        safe = np.abs(det) >= 1e-3
        rows, det, sw, sww, sx, sxw = (v[safe] for v in (rows, det, sw, sww, sx, sxw))
        near = lambda v: np.clip(np.sign(v) * np.floor(np.abs(v) + np.float32(0.5)), self.low, self.high).astype(np.int64)
        return rows, near((sx * sww - sxw * sw) / det), near((n * sxw - sw * sx) / det)

    def run(self) -> None:
        rows = np.arange(len(self.values))
        low, high = self.ends.min(1), self.ends.max(1)
        span = high - low
        flat = span == 0
        self.consider(rows[flat], high[flat], low[flat])
        rows = rows[~flat]
        self.both(rows, high[rows], low[rows])
        ordered = np.sort(self.ends, axis=1)
        distinct = 1 + (np.diff(ordered, axis=1) > 0).sum(1)
        few = rows[(distinct[rows] <= FEW) & (self.error[rows] > np.where(distinct[rows] < FEW, 4, 16))]
        if len(few):
            first = np.concatenate([np.ones((len(few), 1), bool), np.diff(ordered[few], axis=1) > 0], 1)
            number = np.cumsum(first, axis=1) - 1
            held = np.zeros((len(few), FEW), np.int64)
            held[np.arange(len(few))[:, None], number] = ordered[few]
            for i in range(FEW):
                for j in range(FEW):
                    some = (i != j) & (max(i, j) < distinct[few]) & (self.error[few] > 0)
                    self.consider(few[some], held[some, i], held[some, j])
        many = rows[(distinct[rows] > FEW) & (span[rows] > 4)]
        self.both(many, high[many] - 1, low[many] + 1)
        # least squares, again while it helps
        going = rows[(distinct[rows] > 2) & (self.error[rows] > 8)]
        for _ in range(4):
            if not len(going):
                break
            going, a, b = self.least_squares(going)
            before = self.error[going].copy()
            self.both(going, a, b)
            going = going[(self.error[going] > 0) & (self.error[going] < before)]
        # the neighbourhood, where the error is large for the span
        worth = (self.error[rows] > 8) & (self.error[rows] * 16 // np.maximum(span[rows], 1) > 10) & ((distinct[rows] > FEW) | (self.error[rows] > 24))
        near = rows[worth]
        reach, centre = np.where(self.error[near] > 64, 2, 1), (self.e0[near].copy(), self.e1[near].copy())
        for i in range(-2, 3):
            for j in range(-2, 3):
                cross = (distinct[near] <= FEW) | (i == 0) | (j == 0)
                some = (max(abs(i), abs(j)) <= reach) & ((i, j) != (0, 0)) & cross
                self.consider(near[some], np.clip(centre[0][some] + i, self.low, self.high), np.clip(centre[1][some] + j, self.low, self.high))

    def packed(self) -> np.ndarray:
        word = (self.e0 & 255) | (self.e1 & 255) << 8 | (self.index << (16 + 3 * np.arange(16))).sum(1)
        return ((word[:, None] >> (8 * np.arange(8))) & 255).astype(np.uint8)


def encode(values: np.ndarray, signed: bool = False, plain: bool = False) -> np.ndarray:
    """Eight bytes a block of (n, 16) values; ``plain`` tries the extremes only."""
    out = np.empty((len(values), 8), np.uint8)
    for a in range(0, len(values), 1 << 12):
        search = Search(values[a : a + (1 << 12)], signed)
        if plain:
            rows, low, high = np.arange(len(search.values)), search.ends.min(1), search.ends.max(1)
            search.both(rows, high, low)
        else:
            search.run()
        out[a : a + (1 << 12)] = search.packed()
    return out
