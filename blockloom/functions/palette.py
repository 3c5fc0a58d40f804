"""Block-compression arithmetic as Column expressions over integers, visible to the optimizer."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def shr(x: Column, n: int) -> Column:
    return F.shiftright(x, n)


def div(a: Column, b: Column | int) -> Column:
    """Integer division that truncates."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def split565(c: Column | str) -> tuple[Column, Column, Column]:
    c = _c(c)
    return shr(c, 11) % 32, shr(c, 5) % 64, c % 32


def expand565(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """5- and 6-bit channels to 8 bits, as the decoder rounds them."""
    return shr(r * 527 + 23, 6), shr(g * 259 + 33, 6), shr(b * 527 + 23, 6)


def quantise565(r: Column | str, g: Column | str, b: Column | str) -> Column:
    return shr(_c(r), 3) * 2048 + shr(_c(g), 2) * 32 + shr(_c(b), 3)


def replicate565(c: Column | str) -> tuple[Column, Column, Column]:
    """565 back to 8 bits by repeating the top bits, as the encoder scores it."""
    r, g, b = split565(c)
    return r * 8 + shr(r, 2), g * 4 + shr(g, 4), b * 8 + shr(b, 2)


def bc1_palette(c0: Column | str, c1: Column | str, opaque: bool = False) -> Column:
    """Array of four (r, g, b, a): two ends, and thirds, or a half and transparent black where c0 <= c1."""
    p, q = split565(c0), split565(c1)
    four = (_c(c0) > _c(c1)) if not opaque else F.lit(True)
    third = lambda m, n: (shr((m * p[0] + n * q[0]) * 351 + 61, 7), shr((m * p[1] + n * q[1]) * 2763 + 1039, 11), shr((m * p[2] + n * q[2]) * 351 + 61, 7))
    half = (shr((p[0] + q[0]) * 1053 + 125, 8), shr((p[1] + q[1]) * 4145 + 1019, 11), shr((p[2] + q[2]) * 1053 + 125, 8))
    entry = lambda v, a=255: F.struct(*[x.cast("long").alias(n) for x, n in zip((*v, F.lit(a)), "rgba", strict=True)])
    zero = entry((F.lit(0),) * 3, 0)
    return F.array(entry(expand565(*p)), entry(expand565(*q)), F.when(four, entry(third(2, 1))).otherwise(entry(half)), F.when(four, entry(third(1, 2))).otherwise(zero))


#: 16.16 weights of the single-channel palettes.
W4 = (13107, 26215, 39321, 52429)
W6 = (9363, 18724, 28086, 37450, 46812, 56173)


def bc4_palette(a0: Column | str, a1: Column | str, signed: bool = False) -> Column:
    """Eight values: six between the ends where a0 > a1, else four and the extremes."""
    e0, e1 = _c(a0), _c(a1)
    if signed:
        e0, e1 = (F.greatest(F.when(e > 127, e - 256).otherwise(e), F.lit(-127)) for e in (e0, e1))
    e0, e1 = e0.cast("long"), e1.cast("long")
    mid = lambda w: e0 + shr((e1 - e0) * w + 32768, 16)
    low, high = (F.lit(-127), F.lit(127)) if signed else (F.lit(0), F.lit(255))
    return F.when(e0 > e1, F.array(e0, e1, *map(mid, W6))).otherwise(F.array(e0, e1, *map(mid, W4), low.cast("long"), high.cast("long")))


def bc3_alpha_palette(a0: Column | str, a1: Column | str) -> Column:
    """The alpha palette of BC3, which divides instead of weighting."""
    e0, e1 = _c(a0).cast("long"), _c(a1).cast("long")
    six = [div(e0 * (6 - k) + e1 * (k + 1) + 1, 7) for k in range(6)]
    four = [div(e0 * (4 - k) + e1 * (k + 1) + 1, 5) for k in range(4)]
    return F.when(e0 > e1, F.array(e0, e1, *six)).otherwise(F.array(e0, e1, *four, F.lit(0).cast("long"), F.lit(255).cast("long")))


def index_at(word: Column | str, bits: int, pixel: Column) -> Column:
    """The ``pixel``-th field of ``bits`` bits in an index word."""
    return F.call_function("shiftright", _c(word), (pixel * bits).cast("int")) % (1 << bits)


def decode_indexed(palette: Column, word: Column | str, bits: int) -> Column:
    """The sixteen palette entries of a block, in pixel order."""
    return F.transform(F.sequence(F.lit(0), F.lit(15)), lambda p: F.get(palette, index_at(word, bits, p).cast("int")))


def payload_bytes(width: Column | str, height: Column | str, block_bytes: Column | str) -> Column:
    """Bytes of a slice: whole 4x4 blocks, or four bytes a pixel where there are none; null for an empty one."""
    w, h = _c(width), _c(height)
    blocks = div(w + 3, 4) * div(h + 3, 4) * _c(block_bytes)
    return F.when((w > 0) & (h > 0), F.coalesce(blocks, w * h * 4))


def mip_size(size0: Column, level: Column, least: Column | int) -> Column:
    """A level's bytes as the container counts them: a quarter of the level before, not below one block."""
    return F.greatest(F.call_function("shiftright", size0, (level * 2).cast("int")), least if isinstance(least, Column) else F.lit(least))
