"""Pixel relations: block gather, spans, mips, quality metrics, index fits and dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.palette import bc1_palette, div, replicate565

CHANNELS = ("r", "g", "b", "a")


def gather_blocks(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(by, bx, k, r, g, b, a): sixteen pixels for every 4x4 block, the last column and row repeated beyond the edge.

    Each pixel is sent to the places it fills, so no join is needed.
    """
    xs = F.when(F.col("x") == width - 1, F.sequence(F.col("x"), F.lit((width + 3) // 4 * 4 - 1).cast("long"))).otherwise(F.array("x"))
    ys = F.when(F.col("y") == height - 1, F.sequence(F.col("y"), F.lit((height + 3) // 4 * 4 - 1).cast("long"))).otherwise(F.array("y"))
    wide = pixels.withColumn("px", F.explode(xs)).withColumn("py", F.explode(ys))
    return wide.select(div(F.col("py"), 4).alias("by"), div(F.col("px"), 4).alias("bx"), ((F.col("py") % 4) * 4 + F.col("px") % 4).alias("k"), *CHANNELS)


def block_minmax(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("by", "bx").agg(*[f(c).alias(f"{c}_{n}") for c in CHANNELS for f, n in ((F.min, "min"), (F.max, "max"))])


def luminance_extrema(blocks: DataFrame) -> DataFrame:
    """The first darkest and first brightest pixel of each block, by 2r + 3g + b."""
    light = F.col("r") * 2 + F.col("g") * 3 + F.col("b")
    pick = lambda order: F.min(F.struct(order.alias("o"), "k"))
    return blocks.groupBy("by", "bx").agg(pick(light).alias("low"), pick(-light).alias("high")).select("by", "bx", F.col("low.o").alias("dark"), F.col("low.k").alias("dark_k"), (-F.col("high.o")).alias("bright"), F.col("high.k").alias("bright_k"))


def halve(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """The next mip: rounded means of 2x2 boxes; an odd last column or row is dropped unless it is the only one."""
    dw, dh = max(1, width // 2), max(1, height // 2)
    boxed = pixels.select(div(F.col("x"), 2).alias("x"), div(F.col("y"), 2).alias("y"), *CHANNELS).where((F.col("x") < dw) & (F.col("y") < dh))
    n = F.count("*")
    return boxed.groupBy("x", "y").agg(*[div(F.sum(c) + div(n, 2), n).alias(c) for c in CHANNELS])


def psnr(squared: Column, n: Column) -> Column:
    """Peak signal-to-noise ratio from a sum of squared differences over n values; null where there are none, infinite where equal."""
    return F.when(n > 0, F.when(squared == 0, F.lit(float("inf"))).otherwise(10 * F.log10(F.lit(65025.0) / (squared / n))))


def squared_error(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + (x - y) * (x - y)
    return total


def nearest_entry(palette: list[tuple[Column, Column, Column]], pixel: tuple[Column, Column, Column]) -> Column:
    """(distance, index) of the nearest entry; the lowest index wins a tie."""
    return F.least(*[F.struct(squared_error(p, pixel).cast("long").alias("d"), F.lit(i).cast("long").alias("i")) for i, p in enumerate(palette)])


def encoder_palette(c0: Column | str, c1: Column | str) -> list[tuple[Column, Column, Column]]:
    """The four colours an encoder scores with: repeated bits and truncated thirds."""
    p, q = replicate565(c0), replicate565(c1)
    third = lambda m, n: tuple(div(x * m + y * n, 3) for x, y in zip(p, q, strict=True))
    return [p, q, third(2, 1), third(1, 2)]


def top_words(words: DataFrame, most: int = 24) -> DataFrame:
    """The most frequent index words (ties: the smaller), of those that occur twice or more.

    Words are counted before any ordering, and only the counts' top rows meet in one place.
    """
    counted = words.groupBy("word").agg(F.count("*").alias("n"))
    first = counted.orderBy(F.desc("n"), "word").limit(most)
    return first.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "word")).cast("long")).where("n >= 2")


def decode_bc1(blocks: DataFrame) -> DataFrame:
    """(c0, c1, idx, k, r, g, b, a) of each distinct block (c0, c1, idx)."""
    distinct = blocks.select("c0", "c1", "idx").distinct().withColumn("p", bc1_palette("c0", "c1"))
    pixel = distinct.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    entry = F.get("p", (F.call_function("shiftright", F.col("idx"), (F.col("k") * 2).cast("int")) % 4).cast("int"))
    return pixel.withColumn("e", entry).select("c0", "c1", "idx", "k", *[F.col(f"e.{c}").alias(c) for c in CHANNELS])
