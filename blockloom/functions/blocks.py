"""Decoding of compressed 4x4 blocks in numpy, whole columns of blocks at a time.

A kernel takes (n, bytes) uint8 and returns (n, 16, 4) uint8 RGBA, pixels in raster order (BC6H:
float32).  Bits are numbered from the least significant bit of the first byte.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from .palette import W4, W6

# Interpolation weights by index width.
WEIGHTS = {2: (0, 21, 43, 64), 3: (0, 9, 18, 27, 37, 46, 55, 64), 4: (0, 4, 9, 13, 17, 21, 26, 30, 34, 38, 43, 47, 51, 55, 60, 64)}
# The format's partitions into two subsets, one bit a pixel, and the second subset's anchor.
TWO = """cccc 8888 eeee ecc8 c880 feec fec8 ec80 c800 ffec fe80 e800 ffe8 ff00 fff0 f000
f710 008e 7100 08ce 008c 7310 3100 8cce 088c 3110 6666 366c 17e8 0ff0 718e 399c
aaaa f0f0 5a5a 33cc 3c3c 55aa 9696 a55a 73ce 13c8 324c 3bdc 6996 c33c 9966 0660
0272 04e4 4e40 2720 c936 936c 39c6 639c 9336 9cc6 817e e718 ccf0 0fcc 7744 ee22"""
TWO_ANCHOR = """15 15 15 15 15 15 15 15 15 15 15 15 15 15 15 15 15 2 8 2 2 8 8 15 2 8 2 2 8 8 2 2
15 15 6 8 2 8 15 15 2 8 2 2 2 15 15 6 6 2 6 8 15 15 2 2 15 15 15 15 15 2 2 15"""
# The partitions into three subsets, two bits a pixel, and the other subsets' anchors.
THREE = """aa685050 6a5a5040 5a5a4200 5450a0a8 a5a50000 a0a05050 5555a0a0 5a5a5050 aa550000 aa555500 aaaa5500 90909090 94949494 a4a4a4a4 a9a59450 2a0a4250
a5945040 0a425054 a5a5a500 55a0a0a0 a8a85454 6a6a4040 a4a45000 1a1a0500 0050a4a4 aaa59090 14696914 69691400 a08585a0 aa821414 50a4a450 6a5a0200
a9a58000 5090a0a8 a8a09050 24242424 00aa5500 24924924 24499224 50a50a50 500aa550 aaaa4444 66660000 a5a0a5a0 50a050a0 69286928 44aaaa44 66666600
aa444444 54a854a8 95809580 96969600 a85454a8 80959580 aa141414 96960000 aaaa1414 a05050a0 a0a5a5a0 96000000 40804080 a9a8a9a8 aaaaaa44 2a4a5254"""
THREE_ANCHORS = """3,15 3,8 15,8 15,3 8,15 3,15 15,3 15,8 8,15 8,15 6,15 6,15 6,15 5,15 3,15 3,8 3,15 3,8 8,15 15,3 3,15 3,8 6,15 10,8 5,3 8,15 8,6 6,10 8,15 5,15 15,10 15,8
8,15 15,3 3,15 5,10 6,10 10,8 8,9 15,10 15,6 3,15 15,8 5,15 15,3 15,6 15,6 15,8 3,15 15,3 5,15 5,15 5,15 8,15 5,15 10,15 5,15 10,15 8,15 13,15 15,3 12,15 3,15 3,8"""


def _shapes(text: str, bits: int) -> np.ndarray:
    words = np.array([int(x, 16) for x in text.split()], np.int64)
    return (words[:, None] >> (bits * np.arange(16))) & ((1 << bits) - 1)


SUBSETS = {1: np.zeros((1, 16), np.int64), 2: _shapes(TWO, 1), 3: _shapes(THREE, 2)}
_ANCHORS = {1: np.zeros((1, 1), np.int64), 2: np.array([[0, int(x)] for x in TWO_ANCHOR.split()]), 3: np.array([[0, *map(int, x.split(","))] for x in THREE_ANCHORS.split()])}


def bits_of(blocks: np.ndarray) -> np.ndarray:
    return np.unpackbits(blocks, axis=1, bitorder="little")


def field(bits: np.ndarray, first: int, width: int) -> np.ndarray:
    return bits[:, first : first + width].astype(np.int64) @ (1 << np.arange(width, dtype=np.int64))


def _colours(blocks: np.ndarray, opaque: bool) -> np.ndarray:
    bits = bits_of(blocks)
    c0, c1 = field(bits, 0, 16), field(bits, 16, 16)
    p, q = (np.stack([c >> 11, (c >> 5) & 63, c & 31], 1) for c in (c0, c1))
    ends = [(e * np.array([527, 259, 527]) + np.array([23, 33, 23])) >> 6 for e in (p, q)]
    third = lambda m, n: ((m * p + n * q) * np.array([351, 2763, 351]) + np.array([61, 1039, 61])) >> np.array([7, 11, 7])
    half = ((p + q) * np.array([1053, 4145, 1053]) + np.array([125, 1019, 125])) >> np.array([8, 11, 8])
    four = (np.ones(len(c0), bool) if opaque else c0 > c1)[:, None]
    entries = np.full((len(blocks), 4, 4), 255, np.int64)
    entries[:, :, :3] = np.stack([*ends, np.where(four, third(2, 1), half), np.where(four, third(1, 2), 0)], 1)
    entries[:, 3, 3] = np.where(four[:, 0], 255, 0)
    index = np.stack([field(bits, 32 + 2 * k, 2) for k in range(16)], 1)
    return np.take_along_axis(entries, index[:, :, None], 1)


def _ramp(blocks: np.ndarray, kind: str) -> np.ndarray:
    """(n, 16) values of an eight-byte single-channel block: by weights (unsigned or signed) or by division."""
    bits = bits_of(blocks)
    e0, e1 = field(bits, 0, 8), field(bits, 8, 8)
    low, high = 0, 255
    if kind == "signed":
        e0, e1 = (np.maximum(np.where(e > 127, e - 256, e), -127) for e in (e0, e1))
        low, high = -127, 127
    if kind == "divided":
        mid = lambda n, k: ((n - 1 - k) * e0 + (k + 1) * e1 + 1) // n
        six, four = [mid(7, k) for k in range(6)], [mid(5, k) for k in range(4)]
    else:
        six, four = ([e0 + ((w * (e1 - e0) + 32768) >> 16) for w in ws] for ws in (W6, W4))
    flat = np.zeros_like(e0)
    entries = np.where((e0 > e1)[:, None], np.stack([e0, e1, *six], 1), np.stack([e0, e1, *four, flat + low, flat + high], 1))
    index = np.stack([field(bits, 16 + 3 * k, 3) for k in range(16)], 1)
    return np.take_along_axis(entries, index, 1) & 255


def decode_bc1(blocks: np.ndarray) -> np.ndarray:
    return _colours(blocks, False).astype(np.uint8)


def decode_bc2(blocks: np.ndarray) -> np.ndarray:
    out = _colours(blocks[:, 8:], True)
    bits = bits_of(blocks[:, :8])
    out[:, :, 3] = np.stack([field(bits, 4 * k, 4) for k in range(16)], 1) * 17
    return out.astype(np.uint8)


def decode_bc3(blocks: np.ndarray) -> np.ndarray:
    out = _colours(blocks[:, 8:], True)
    out[:, :, 3] = _ramp(blocks[:, :8], "divided")
    return out.astype(np.uint8)


def _planes(n: int, planes: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((n, 16, 4), np.uint8)
    out[:, :, 3] = 255
    for c, plane in enumerate(planes):
        out[:, :, c] = plane
    return out


def decode_bc4(blocks: np.ndarray, signed: bool = False) -> np.ndarray:
    """Red only; signed values stay the bit patterns of their bytes."""
    return _planes(len(blocks), [_ramp(blocks, "signed" if signed else "unsigned")])


def decode_bc5(blocks: np.ndarray, signed: bool = False) -> np.ndarray:
    kind = "signed" if signed else "unsigned"
    return _planes(len(blocks), [_ramp(blocks[:, :8], kind), _ramp(blocks[:, 8:], kind)])


@dataclass(frozen=True)
class Mode:
    """Field widths of a BC7 mode, in the order of the format's table."""

    subsets: int
    partition: int
    rotation: int
    select: int
    colour: int
    alpha: int
    own_p: int
    shared_p: int
    index: int
    second: int


# The format's eight modes.
MODES = (Mode(3, 4, 0, 0, 4, 0, 1, 0, 3, 0), Mode(2, 6, 0, 0, 6, 0, 0, 1, 3, 0), Mode(3, 6, 0, 0, 5, 0, 0, 0, 2, 0), Mode(2, 6, 0, 0, 7, 0, 1, 0, 2, 0), Mode(1, 0, 2, 1, 5, 6, 0, 0, 2, 3), Mode(1, 0, 2, 0, 7, 8, 0, 0, 2, 2), Mode(1, 0, 0, 0, 7, 7, 1, 0, 4, 0), Mode(2, 6, 0, 0, 5, 5, 1, 0, 2, 0))


def _indices(bits: np.ndarray, first: int, width: int, anchors: np.ndarray) -> np.ndarray:
    """(n, 16) indices; an anchor stores one bit less, its top bit being zero."""
    short = (anchors[:, None, :] == np.arange(16)[None, :, None]).any(2)
    size = width - short
    at = first + np.cumsum(size, axis=1) - size
    out = np.zeros(at.shape, np.int64)
    for b in range(width):
        where = np.minimum(at + b, bits.shape[1] - 1)
        out += np.where(b < size, np.take_along_axis(bits, where, 1).astype(np.int64) << b, 0)
    return out


def _decode_mode(bits: np.ndarray, number: int) -> np.ndarray:
    m, n, at = MODES[number], len(bits), number + 1

    def take(width: int) -> np.ndarray:
        nonlocal at
        at += width
        return field(bits, at - width, width)

    shape, rotation, select = take(m.partition), take(m.rotation), take(m.select)
    channels = 4 if m.alpha else 3
    ends = np.full((n, 2 * m.subsets, 4), 255, np.int64)
    for c in range(channels):
        for e in range(2 * m.subsets):
            ends[:, e, c] = take(m.alpha if c == 3 else m.colour)
    extra = m.own_p or m.shared_p
    if extra:
        p = np.stack([take(1) for _ in range(2 * m.subsets if m.own_p else m.subsets)], 1)
        p = p if m.own_p else np.repeat(p, 2, axis=1)
        ends[:, :, :channels] = ends[:, :, :channels] * 2 + p[:, :, None]
    for c in range(channels):
        width = (m.alpha if c == 3 else m.colour) + bool(extra)
        ends[:, :, c] = (ends[:, :, c] << (8 - width)) | (ends[:, :, c] << (8 - width) >> width)
    anchors = _ANCHORS[m.subsets][shape]
    first = _indices(bits, at, m.index, anchors)
    at += 16 * m.index - m.subsets
    if m.second:
        second = _indices(bits, at, m.second, anchors)
        w1, w2 = np.array(WEIGHTS[m.index])[first], np.array(WEIGHTS[m.second])[second]
        swap = (select == 1)[:, None]
        weights = np.where(swap, w2, w1), np.where(swap, w1, w2)
    else:
        w = np.array(WEIGHTS[m.index])[first]
        weights = w, w
    subset = SUBSETS[m.subsets][shape]
    rows = np.arange(n)[:, None]
    e0, e1 = ends[rows, 2 * subset], ends[rows, 2 * subset + 1]
    w = np.stack([weights[0]] * 3 + [weights[1]], 2)
    out = (e0 * (64 - w) + e1 * w + 32) >> 6
    if not m.alpha:
        out[:, :, 3] = 255
    for c in range(3):
        turned = np.flatnonzero(rotation == c + 1)
        out[turned, :, c], out[turned, :, 3] = out[turned, :, 3], out[turned, :, c].copy()
    return out


def decode_bc7(blocks: np.ndarray) -> np.ndarray:
    """All eight modes; a block without a mode bit is zero."""
    out = np.zeros((len(blocks), 16, 4), np.uint8)
    bits = bits_of(blocks)
    head = bits[:, :8]
    mode = np.where(head.any(axis=1), head.argmax(axis=1), 8)
    for number in range(8):
        own = np.flatnonzero(mode == number)
        if len(own):
            out[own] = _decode_mode(bits[own], number)
    return out


def half_to_float(patterns: np.ndarray) -> np.ndarray:
    return patterns.astype(np.uint16).view(np.float16).astype(np.float32)


def decode_bc6h_single(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n, 16, 4) floats of unsigned blocks of the one-subset mode with 10-bit ends, and which blocks those are."""
    bits = bits_of(blocks)
    own = field(bits, 0, 5) == 3
    ends = np.stack([field(bits, 5 + 10 * k, 10) for k in range(6)], 1)
    ends = np.where(ends == 0, 0, np.where(ends == 1023, 0xFFFF, ((ends << 16) + 0x8000) >> 10))
    index = _indices(bits, 65, 4, np.zeros((len(blocks), 1), np.int64))
    w = np.array(WEIGHTS[4])[index][:, :, None]
    mixed = (ends[:, None, :3] * (64 - w) + ends[:, None, 3:] * w + 32) >> 6
    out = np.ones((len(blocks), 16, 4), np.float32)
    out[:, :, :3] = half_to_float((mixed * 31) >> 6)
    out[~own] = 0
    return out, own


DECODERS = {"bc1": (8, decode_bc1), "bc2": (16, decode_bc2), "bc3": (16, decode_bc3), "bc4u": (8, decode_bc4), "bc4s": (8, lambda b: decode_bc4(b, True)), "bc5u": (16, decode_bc5), "bc5s": (16, lambda b: decode_bc5(b, True)), "bc7": (16, decode_bc7)}


#: Blocks that one call of a kernel decodes.
AT_ONCE = 1 << 14


def slice_bytes(content: str, width: int, height: int) -> int:
    if content in ("rgba8", "bgra8"):
        return 4 * width * height
    return (width + 3) // 4 * ((height + 3) // 4) * (16 if content.startswith("bc6h") else DECODERS[content][0])


def decode_many(content: str, slices: list[tuple[bytes, int, int]]) -> list[tuple[bytes | None, str | None]]:
    """RGBA bytes of each slice (payload, width, height) of one class, or the name of what is wrong with it; the kernel sees the blocks of all of them together."""
    out: list[tuple[bytes | None, str | None]] = [(None, "UnsupportedFormat")] * len(slices)
    if content not in DECODERS and content not in ("rgba8", "bgra8"):
        return [(None, "InvalidField") if min(w, h) <= 0 else x for x, (_, w, h) in zip(out, slices, strict=True)]
    good = []
    for i, (payload, w, h) in enumerate(slices):
        error = "InvalidField" if min(w, h) <= 0 else "TruncatedData" if len(payload) < slice_bytes(content, w, h) else None
        out[i] = (None, error)
        if error is None:
            good.append(i)
    if content in ("rgba8", "bgra8"):
        for i in good:
            payload, w, h = slices[i]
            px = np.frombuffer(payload, np.uint8, 4 * w * h).reshape(-1, 4)
            out[i] = ((px if content == "rgba8" else px[:, [2, 1, 0, 3]]).tobytes(), None)
        return out
    size, kernel = DECODERS[content]
    at = 0
    while at < len(good):
        # as many slices as fill a call; a larger slice goes in parts
        some, n = [], 0
        while at < len(good) and (not some or n + slice_bytes(content, *slices[good[at]][1:]) // size <= AT_ONCE):
            some.append(good[at])
            n += slice_bytes(content, *slices[good[at]][1:]) // size
            at += 1
        joined = np.concatenate([np.frombuffer(slices[i][0], np.uint8, slice_bytes(content, *slices[i][1:])).reshape(-1, size) for i in some])
        px = np.concatenate([kernel(joined[a : a + AT_ONCE]) for a in range(0, len(joined), AT_ONCE)])
        first = 0
        for i in some:
            _, w, h = slices[i]
            bx, by = (w + 3) // 4, (h + 3) // 4
            own = px[first : first + bx * by]
            first += bx * by
            out[i] = (own.reshape(by, bx, 4, 4, 4).swapaxes(1, 2).reshape(4 * by, 4 * bx, 4)[:h, :w].tobytes(), None)
    return out


def decode_surface(content: str, payload: bytes, width: int, height: int) -> tuple[bytes | None, str | None]:
    """``decode_many`` of one slice."""
    return decode_many(content, [(payload, width, height)])[0]


def decode_volume(content: str, payload: bytes, width: int, height: int, depth: int) -> tuple[bytes | None, str | None]:
    """The slices of a volume, one behind the other."""
    if min(width, height, depth) <= 0:
        return None, "InvalidField"
    if content not in DECODERS and content not in ("rgba8", "bgra8"):
        return None, "UnsupportedFormat"
    size = slice_bytes(content, width, height)
    done = decode_many(content, [(payload[z * size : (z + 1) * size], width, height) for z in range(depth)])
    return next(((None, e) for _, e in done if e), (b"".join(x for x, _ in done if x is not None), None))


def block_height(content: str) -> int:
    return 1 if content in ("rgba8", "bgra8") else 4


def decode_block_rows(content: str, payload: bytes, width: int, height: int, first: int, end: int) -> tuple[bytes | None, str | None]:
    """The pixel rows of the block rows from ``first`` to before ``end`` of one slice."""
    if content not in DECODERS and content not in ("rgba8", "bgra8"):
        return None, "UnsupportedFormat"
    tall = block_height(content)
    if first < 0 or first > end or end > -(-height // tall):
        return None, "OutOfBounds"
    low, high = first * tall, min(end * tall, height)
    if low >= high:
        return b"", None
    row = slice_bytes(content, width, tall)
    return decode_surface(content, payload[first * row : end * row], width, high - low)


def decode_float(signed: bool, payload: bytes, width: int, height: int, depth: int = 1) -> tuple[bytes | None, str | None]:
    """Little-endian RGBA floats of unsigned HDR blocks of the one-subset mode; other modes and signed blocks are not supported."""
    if min(width, height, depth) <= 0:
        return None, "InvalidField"
    bx, by = (width + 3) // 4, (height + 3) // 4
    if len(payload) < 16 * bx * by * depth:
        return None, "TruncatedData"
    px, own = decode_bc6h_single(np.frombuffer(payload, np.uint8, 16 * bx * by * depth).reshape(-1, 16))
    if signed or not own.all():
        return None, "UnsupportedFormat"
    return px.reshape(depth, by, bx, 4, 4, 4).swapaxes(2, 3).reshape(depth, 4 * by, 4 * bx, 4)[:, :height, :width].tobytes(), None
