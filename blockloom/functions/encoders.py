"""Encoding of 4x4 blocks in numpy: (n, 16, 4) uint8 pixels in raster order to (n, bytes) uint8.

Colour ends come from two seeds, the first darkest and brightest pixel by 2r + 3g + b and the
channels' extremes; the one with the smaller error wins, the first on a tie, and its ends are refined
by least squares and by single steps while the error falls.  Single channels are searched in ``alpha``.
"""

from __future__ import annotations

import numpy as np

from . import alpha
from .bc7 import encode_mode6


def to565(c: np.ndarray) -> np.ndarray:
    c = c.astype(np.int64)
    return (c[..., 0] >> 3 << 11) | (c[..., 1] >> 2 << 5) | (c[..., 2] >> 3)


def from565(w: np.ndarray) -> np.ndarray:
    r, g, b = w >> 11, (w >> 5) & 63, w & 31
    return np.stack([r << 3 | r >> 2, g << 2 | g >> 4, b << 3 | b >> 2], -1)


def _words(values: np.ndarray, width: int) -> np.ndarray:
    """Little-endian bytes of each value."""
    return ((values[:, None] >> (8 * np.arange(width))) & 255).astype(np.uint8)


def _fit_colour(px: np.ndarray, c0: np.ndarray, c1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks and squared errors of the four-colour palette of two 565 ends; equal ends are moved one apart."""
    c0 = np.where((c0 == c1) & (c0 < 0xFFFF), c0 + 1, c0)
    high, low = np.maximum(c0, c1), np.minimum(c0, c1)
    p, q = from565(high), from565(low)
    entries = np.stack([p, q, (2 * p + q) // 3, (p + 2 * q) // 3], 1)
    white = high == low  # only two ends of all ones: three colours and transparent black
    entries[white, 2] = (p[white] + q[white]) // 2
    d = ((px[:, :, None, :3].astype(np.int64) - entries[:, None]) ** 2).sum(-1)
    d[white, :, 3] = np.iinfo(np.int64).max // 32
    index = d.argmin(2)
    word = (index << (2 * np.arange(16))).sum(1)
    return np.concatenate([_words(high, 2), _words(low, 2), _words(word, 4)], 1), np.take_along_axis(d, index[:, :, None], 2)[:, :, 0].sum(1)


def encode_bc1(px: np.ndarray, rounds: int = 4) -> np.ndarray:
    """Without ``rounds`` of refinement this is the fast quality."""
    own = px.astype(np.int64)
    light = own[:, :, 0] * 2 + own[:, :, 1] * 3 + own[:, :, 2]
    rows = np.arange(len(px))
    first = to565(px[rows, light.argmax(1)]), to565(px[rows, light.argmin(1)])
    best, error = _fit_colour(px, *first)
    high, low = px[:, :, :3].max(1), px[:, :, :3].min(1)
    other, other_error = _fit_colour(px, to565(high), to565(low))
    wide = (high.astype(np.int64) - low).sum(1) >= 24
    better = wide & (other_error < error)
    best, error = np.where(better[:, None], other, best), np.where(better, other_error, error)
    for _ in range(rounds):
        ends, solved = _least_squares(px, best)
        other, other_error = _fit_colour(px, *ends)
        better = wide & solved & (other_error < error)
        if not better.any():
            break
        best, error = np.where(better[:, None], other, best), np.where(better, other_error, error)
    return _climb(px, best, error, wide, rounds)


def _climb(px: np.ndarray, best: np.ndarray, error: np.ndarray, some: np.ndarray, rounds: int) -> np.ndarray:
    """Move one channel of one end by one step at a time while that lowers the error."""
    for _ in range(rounds):
        moved = False
        for end in (0, 1):
            for shift, top in ((11, 31), (5, 63), (0, 31)):
                for step in (-1, 1):
                    ends = [best[:, 2 * e].astype(np.int64) | best[:, 2 * e + 1].astype(np.int64) << 8 for e in (0, 1)]
                    level = (ends[end] >> shift) & top
                    inside = some & (level + step >= 0) & (level + step <= top) & (error > 0)
                    ends[end] = np.where(inside, ends[end] + (step << shift), ends[end])
                    other, other_error = _fit_colour(px, *ends)
                    better = inside & (other_error < error)
                    best, error = np.where(better[:, None], other, best), np.where(better, other_error, error)
                    moved |= bool(better.any())
        if not moved:
            break
    return best


def _least_squares(px: np.ndarray, packed: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """The two 565 ends that fit the pixels best under the indices of ``packed``, and where there are such."""
    word = packed[:, 4:8].astype(np.int64) @ (1 << 8 * np.arange(4))
    index = (word[:, None] >> (2 * np.arange(16))) & 3
    a = np.array([1, 0, 2 / 3, 1 / 3])[index]
    b = 1 - a
    aa, bb, ab = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
    det = aa * bb - ab * ab
    safe = np.where(np.abs(det) > 1e-4, det, 1)[:, None]
    colour = px[:, :, :3].astype(np.float64)
    ax, bx = (a[:, :, None] * colour).sum(1), (b[:, :, None] * colour).sum(1)
    ends = (bb[:, None] * ax - ab[:, None] * bx) / safe, (aa[:, None] * bx - ab[:, None] * ax) / safe
    return tuple(_nearest565(e) for e in ends), np.abs(det) > 1e-4


def _nearest565(c: np.ndarray) -> np.ndarray:
    q = np.floor(np.clip(c, 0, 255) * np.array([31, 63, 31]) / 255 + 0.5).astype(np.int64)
    return (q[:, 0] << 11) | (q[:, 1] << 5) | q[:, 2]


def encode_bc4(values: np.ndarray, signed: bool = False, plain: bool = False) -> np.ndarray:
    """Blocks of (n, 16) values."""
    return alpha.encode(values, signed, plain)


def _bc5(px: np.ndarray, signed: bool = False, plain: bool = False) -> np.ndarray:
    return np.concatenate([encode_bc4(px[:, :, c], signed, plain) for c in (0, 1)], 1)


def encode_bc2(px: np.ndarray) -> np.ndarray:
    alpha = (px[:, :, 3].astype(np.int64) >> 4).reshape(-1, 8, 2)
    return np.concatenate([(alpha[:, :, 0] | alpha[:, :, 1] << 4).astype(np.uint8), encode_bc1(px)], 1)


ENCODERS = {
    "bc1": encode_bc1, "bc2": encode_bc2, "bc3": lambda px: np.concatenate([encode_bc4(px[:, :, 3]), encode_bc1(px)], 1), "bc4u": lambda px: encode_bc4(px[:, :, 0]), "bc4s": lambda px: encode_bc4(px[:, :, 0], True), "bc5u": _bc5, "bc5s": lambda px: _bc5(px, True), "bc7": encode_mode6,
}
#: Blocks of several images that are encoded together, about.
AT_ONCE = 4096
#: Channels whose span over the whole surface decides whether the search would pay.
FLAT = {"bc4u": (0,), "bc4s": (0,), "bc5u": (0, 1), "bc5s": (0, 1)}


def encode_blocks(content: str, image: np.ndarray) -> bytes:
    """The blocks of one (h, w, 4) level; a nearly flat one takes its extremes without a search."""
    if content in ("rgba8", "bgra8"):
        return (image if content == "rgba8" else image[:, :, [2, 1, 0, 3]]).tobytes()
    px = to_blocks(image)
    held = [image[:, :, c] for c in FLAT.get(content, ())]
    if held and all(int(x.max()) - int(x.min()) <= 2 for x in held):
        return np.concatenate([encode_bc4(px[:, :, c], content.endswith("s"), True) for c in FLAT[content]], 1).tobytes()
    return ENCODERS[content](px).tobytes()


def encode_many(content: str, images: np.ndarray) -> list[bytes]:
    """``encode_blocks`` of each of (n, h, w, 4) levels; the encoder sees the blocks of all of them together."""
    if content not in ENCODERS:
        return [encode_blocks(content, x) for x in images]
    flat = np.zeros(len(images), bool)
    if content in FLAT:
        held = images[..., list(FLAT[content])].astype(int)
        flat = (held.max((1, 2)) - held.min((1, 2)) <= 2).all(axis=1)
    out = [encode_blocks(content, x) if f else b"" for x, f in zip(images, flat, strict=True)]
    some = np.flatnonzero(~flat)
    step = max(1, AT_ONCE * 16 // max(1, images.shape[1] * images.shape[2]))
    for a in range(0, len(some), step):
        part = some[a : a + step]
        done = ENCODERS[content](np.concatenate([to_blocks(images[i]) for i in part]))
        for i, data in zip(part.tolist(), done.reshape(len(part), -1), strict=True):
            out[i] = data.tobytes()
    return out


def to_blocks(image: np.ndarray) -> np.ndarray:
    """(h, w, 4) pixels as blocks, the last row and column repeated beyond the edge."""
    h, w = image.shape[:2]
    wide = np.pad(image, ((0, -h % 4), (0, -w % 4), (0, 0)), mode="edge")
    return wide.reshape(wide.shape[0] // 4, 4, wide.shape[1] // 4, 4, 4).swapaxes(1, 2).reshape(-1, 16, 4)


def halve(image: np.ndarray) -> np.ndarray:
    """The next mip of (h, w, 4) or (d, h, w, 4): rounded means of boxes two wide, an odd last line dropped unless it is the only one."""
    if image.ndim == 3:
        return halve(image[None])[0]
    zs, ys, xs = ((np.arange(max(1, n // 2)) * 2)[:, None] + np.arange(min(n, 2)) for n in image.shape[:3])
    box = image[zs[:, :, None, None, None, None], ys[None, None, :, :, None, None], xs[None, None, None, None]].astype(np.int64)
    n = box.shape[1] * box.shape[3] * box.shape[5]
    return ((box.sum((1, 3, 5)) + n // 2) // n).astype(np.uint8)


def encode_surface(content: str, rgba: bytes, width: int, height: int, mips: int = 1, depth: int = 1) -> tuple[bytes | None, str | None]:
    """All levels of one image or volume, largest first, or the name of what is wrong."""
    if min(width, height, mips, depth) <= 0:
        return None, "InvalidField"
    if len(rgba) != 4 * width * height * depth:
        return None, "TruncatedData"
    if content not in ENCODERS and content not in ("rgba8", "bgra8"):
        return None, "UnsupportedFormat"
    image, out = np.frombuffer(rgba, np.uint8).reshape(depth, height, width, 4), []
    for level in range(mips):
        out += [encode_blocks(content, x) for x in image]
        image = halve(image) if level + 1 < mips else image
    return b"".join(out), None


def encode_slices(content: str, rgba: bytes, width: int, height: int, depth: int, mips: int, slices: int) -> tuple[bytes | None, str | None]:
    """A container's payload: each slice's levels, every level in the room that the container counts for it."""
    if min(width, height, depth, mips, slices) <= 0 or depth > 1 and slices > 1:
        return None, "InvalidField"
    if content not in ENCODERS and content not in ("rgba8", "bgra8"):
        return None, "UnsupportedFormat"
    size = 4 * width * height * depth
    if len(rgba) < size * slices:
        return None, "TruncatedData"
    least = 4 if content in ("rgba8", "bgra8") else 8 if content in ("bc1", "bc4u", "bc4s") else 16
    out = []
    for s in range(slices):
        image = np.frombuffer(rgba, np.uint8, size, s * size).reshape(depth, height, width, 4)
        room = least * depth * (width * height if least == 4 else (width + 3) // 4 * ((height + 3) // 4))
        for level in range(mips):
            data = b"".join(encode_blocks(content, x) for x in image)
            if len(data) > room:
                return None, "TruncatedData"
            out.append(data.ljust(room, b"\0"))
            image, room = halve(image) if level + 1 < mips else image, max(room // 4, least)
    return b"".join(out), None
