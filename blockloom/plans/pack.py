"""Packs of textures: procedural images, cooking them into containers, and the pack's manifest as text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import encoders, formats, hdr
from ..functions.hashes import OFFSET, PRIME, fnv1a, fold
from ..operators import containers
from ..sources.textures import WRITTEN
from . import scenario

# Seed of the images, octaves of their noise, and discs in each.
SEED, OCTAVES, DISCS = 0x5A17C0DE, 5, 6
_f = np.float32


def lattice(seed: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A number from 0 to below 1 for each point of the integer lattice."""
    h = np.full(x.shape, seed, np.uint64)
    for value in (x, y):
        for byte in np.ascontiguousarray(value.astype("<i4")).view(np.uint8).reshape(*x.shape, 4).astype(np.uint64).transpose(-1, *range(x.ndim)):
            h = (h ^ byte) * np.uint64(PRIME)
    return (h >> np.uint64(40)).astype(_f) / _f(1 << 24)


def noise(seed: int, x: np.ndarray, y: np.ndarray, octaves: int = OCTAVES) -> np.ndarray:
    """Smoothed lattice values, each octave half as strong and twice as fine."""
    total, weight = np.zeros(x.shape, _f), _f(0)
    for octave in range(octaves):
        own, u, v = seed ^ octave << 32, x * _f(1 << octave), y * _f(1 << octave)
        i, j = np.floor(u), np.floor(v)
        s, t = ((w * w * (_f(3) - _f(2) * w)) for w in (u - i, v - j))
        i, j = i.astype(np.int64), j.astype(np.int64)
        near, far = (lattice(own, i, k) + (lattice(own, i + 1, k) - lattice(own, i, k)) * s for k in (j, j + 1))
        total = total + _f(0.5**octave) * (near + (far - near) * t)
        weight += _f(0.5**octave)
    return total / weight


def image(content: str, number: int, size: int) -> np.ndarray:
    """(size, size, 4) pixels of a pack's texture: tinted noise with discs, heights, or the normals of them."""
    seed = fnv1a(number.to_bytes(4, "little"), SEED)
    drawn = scenario.draws(seed, np.arange(4 + 3 * DISCS))
    scale = scenario.between(drawn[0], 3, 9) / _f(size)
    tint = scenario.between(drawn[1:4], 0.45, 1)
    y, x = (a.astype(_f) for a in np.mgrid[:size, :size])
    height = lambda u, v: noise(seed, u * scale, v * scale)
    n = height(x, y)
    for k in range(DISCS):
        cx, cy, r = (scenario.between(drawn[4 + 3 * k + i], a * size, b * size) for i, (a, b) in enumerate(((0, 1), (0, 1), (0.03, 0.12))))
        inside = np.sqrt((x - cx) ** 2 + (y - cy) ** 2) < r
        n = np.where(inside, np.minimum(n * _f(0.35) + _f(0.65), _f(1)), n)
    out = np.full((size, size, 4), 255, np.uint8)
    if content.startswith("bc5"):
        slope = np.stack([(height(x - 1, y) - height(x + 1, y)) * _f(8), (height(x, y - 1) - height(x, y + 1)) * _f(8), np.ones_like(n)], -1)
        unit = slope / np.maximum(np.sqrt((slope**2).sum(-1, keepdims=True)), _f(1e-6))
        out[:, :, :3] = np.floor(np.clip(unit * _f(0.5) + _f(0.5), 0, 1) * _f(255) + _f(0.5))
    elif content.startswith("bc4"):
        out[:, :, :3] = (n * _f(255)).astype(np.uint8)[:, :, None]
    else:
        out[:, :, :3] = n[:, :, None] * tint * _f(255)
        if content in ("bc2", "bc3"):
            out[:, :, 3] = height(x * _f(1.7) + _f(91), y * _f(1.7) - _f(37)) * _f(255)
    return out


def halve_float(pixels: np.ndarray) -> np.ndarray:
    """The next level of (h, w, c) floats: means of boxes two wide, one wide where there is one line only."""
    ys, xs = ((np.arange(max(1, n // 2)) * 2)[:, None] + np.arange(min(n, 2)) for n in pixels.shape[:2])
    return pixels[ys[:, :, None, None], xs[None, None]].mean(axis=(1, 3), dtype=np.float32)


def payload(content: str, number: int, size: int, levels: int) -> bytes:
    """A texture's levels, encoded; HDR ones are the image's colours over a range of brightness."""
    if content != "bc6h":
        data, error = encoders.encode_slices(content, image(content, number, size).tobytes(), size, size, 1, levels, 1)
        if error:
            raise ValueError(error)
        return data
    px = image("bc1", number, size)[:, :, :3].astype(_f)
    px = np.exp2(px / _f(32)) - _f(1)
    out = []
    for _ in range(levels):
        wide = np.pad(px, ((0, -px.shape[0] % 4), (0, -px.shape[1] % 4), (0, 0)), mode="edge")
        grid = wide.reshape(wide.shape[0] // 4, 4, wide.shape[1] // 4, 4, 3).swapaxes(1, 2).reshape(-1, 16, 3)
        out.append(hdr.encode_bc6h(grid).tobytes())
        px = halve_float(px)
    return b"".join(out)


def cook(spark: SparkSession, tier: str, textures: int, size: int) -> DataFrame:
    """tex, file, content (class), width, height, mips, bytes, hash (16 hex digits) and data of each texture of a new pack."""
    if size < 4 or size & (size - 1):
        raise ValueError("a pack's size is a power of two from 4 on")
    if textures <= 0:
        raise ValueError("a pack has one texture at least")
    levels = size.bit_length()
    of_name = {r["name"]: r for r in formats.dxgi_rows()}
    codes = {c: n for c, n in WRITTEN.items()} | {"bc6h": "BC6H_UF16"}
    dim = spark.createDataFrame([(c, of_name[n]["code"], of_name[n]["bits_per_pixel"], of_name[n]["block_bytes"]) for c, n in codes.items()], "content string, dxgi bigint, bits bigint, block bigint")
    ids = scenario.contents(spark.range(textures).select(F.col("id").alias("tex"), F.lit(tier).alias("tier"))).join(F.broadcast(dim), "content")
    none, of = F.lit(None).cast("long"), lambda v: F.lit(v).cast("long")
    wanted = ids.withColumns({"width": of(size), "height": of(size), "depth": none, "mips": of(levels), "layers": none, "is_cube": F.lit(False), "packed": F.lit(False), "dimension": of(3), "alpha_mode": of(1), "caps2": none, "fourcc": none, **{f"{c}_mask": none for c in "rgba"}})
    heads = containers.new_container(wanted).select("tex", "content", "header")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, content, head in zip(*(batch.column(c).to_pylist() for c in ("tex", "content", "header")), strict=True):
                data = head + payload(content, number, size, levels)
                row = (number, f"t{number:04}_{content}.dds", content, size, size, levels, len(data), f"{fnv1a(data):016x}", data)
                types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["tex", "file", "content", "width", "height", "mips", "bytes", "hash", "data"])

    return heads.repartition(spark.sparkContext.defaultParallelism).mapInArrow(run, "tex long, file string, content string, width long, height long, mips long, bytes long, hash string, data binary")


def pack_hash(textures: DataFrame) -> str:
    """The textures' hashes folded in their order; a pack's list is as long as its number of textures."""
    return f"{fold([int(r.hash, 16) for r in textures.select('tex', 'hash').orderBy('tex').toLocalIterator()], OFFSET):016x}"


def manifest(textures: DataFrame, tier: str, size: int, rdo_lambda: float) -> list[str]:
    """The lines of a pack's manifest, its own fields first."""
    rows = textures.select("tex", "file", "content", "width", "height", "mips", "bytes", "hash").orderBy("tex").collect()
    head = ["# pack manifest v1", "source procedural", f"tier {tier}", f"size {size}", f"rdo_lambda {rdo_lambda:g}", f"total_bytes {sum(r.bytes for r in rows)}", f"hash {pack_hash(textures)}"]
    return head + [f"texture {r.file} {r.content} {r.width} {r.height} {r.mips} {r.bytes} {r.hash}" for r in rows]


def parse_manifest(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """A pack's fields (key, value) and its textures; unknown lines are ignored, a texture line with a missing or bad part has an error."""
    words = F.split(F.trim(F.col(value)), r"\s+")
    split = lines.withColumn("words", words)
    fields = split.where(F.get("words", F.lit(0)).isin("tier", "size", "rdo_lambda", "total_bytes", "hash")).select(*[c for c in lines.columns if c != value], F.get("words", F.lit(0)).alias("key"), F.get("words", F.lit(1)).alias("value"))
    whole = lambda i: F.expr(f"try_cast(get(words, {i}) as long)")
    rows = split.where(F.get("words", F.lit(0)) == "texture").select(*[c for c in lines.columns if c != value], F.get("words", F.lit(1)).alias("file"), F.get("words", F.lit(2)).alias("content"), whole(3).alias("width"), whole(4).alias("height"), whole(5).alias("mips"), whole(6).alias("bytes"), F.lower(F.get("words", F.lit(7))).alias("hash"))
    good = F.col("content").isin(*[c for c, _ in formats.CONTENT], "bc6h") & F.col("width").isNotNull() & F.col("height").isNotNull() & F.col("mips").isNotNull() & F.col("bytes").isNotNull() & F.col("hash").rlike("^[0-9a-f]{1,16}$")
    return fields, rows.withColumn("error", F.when(~F.coalesce(good, F.lit(False)), "InvalidField"))
