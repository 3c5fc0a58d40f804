"""Whole containers: their subresources listed, sliced and decoded, and images encoded into new ones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import blocks, encoders, formats, legacy
from ..operators import containers
from . import dds

# The format that each content class is written as.
WRITTEN = {"bc1": "BC1_UNorm", "bc2": "BC2_UNorm", "bc3": "BC3_UNorm", "bc4u": "BC4_UNorm", "bc4s": "BC4_SNorm", "bc5u": "BC5_UNorm", "bc5s": "BC5_SNorm", "bc7": "BC7_UNorm", "rgba8": "R8G8B8A8_UNorm", "bgra8": "B8G8R8A8_UNorm"}
#: Fixed value: order of a cube's faces.
FACES = ("+X", "-X", "+Y", "-Y", "+Z", "-Z")
_CUBE_ALL = 0xFE00


def described(files: DataFrame, content: str = "content") -> DataFrame:
    """Files (binary ``content``) with their parsed headers, format (DXGI before legacy), sizes and counts; what is wrong is in ``error``."""
    spark = files.sparkSession
    parsed = dds.parse(files, content).withColumnRenamed("error", "header_error").withColumn("pf_flags", F.coalesce(dds.word(content, 80), F.lit(0).cast("long")))
    codes = [(r["code"], r["name"], r["bits_per_pixel"], r["block_bytes"], r["content"], r["hdr_content"]) for r in formats.dxgi_rows()]
    dim = spark.createDataFrame(codes, "code bigint, dxgi_name string, dxgi_bits bigint, dxgi_block bigint, dxgi_content string, hdr_content string")
    of_name = {r[1]: r[0] for r in codes}
    short = spark.createDataFrame([(legacy.code(k), of_name[v]) for k, v in formats.FOURCC.items()], "short bigint, short_code bigint")
    told = parsed.join(F.broadcast(short), F.col("fourcc") == F.col("short"), "left").withColumn("dx10", F.col("dxgi").isNotNull())
    told = told.withColumn("dxgi_code", F.coalesce("dxgi", "short_code")).join(F.broadcast(dim), F.col("dxgi_code") == F.col("code"), "left").drop("short", "short_code", "code")
    named = containers.legacy_format(told).withColumnsRenamed({"name": "legacy_name", "bits_per_pixel": "legacy_bits", "block_bytes": "legacy_block", "content": "legacy_content"} if content != "content" else {"name": "legacy_name", "bits_per_pixel": "legacy_bits", "block_bytes": "legacy_block"})
    own = F.col("dxgi_name").isNotNull()
    pick = lambda a, b: F.when(own, F.col(a)).otherwise(F.col(b))
    known = named.withColumns({"format": pick("dxgi_name", "legacy_name"), "bits": pick("dxgi_bits", "legacy_bits"), "block": pick("dxgi_block", "legacy_block"), "class": pick("dxgi_content", "legacy_content")})
    known = known.withColumn("packed", F.coalesce(F.col("format").isin(*legacy.PACKED), F.lit(False)))
    sized = containers.metrics(known).withColumn("error", F.coalesce("header_error", "error")).drop("header_error")
    one = F.lit(1).cast("long")
    count = F.when(F.col("dx10"), F.greatest("array_size", one)).otherwise(one)
    return sized.withColumns({"array_layers": F.col("layers"), "layers": count, "faces": F.when(F.col("is_cube"), F.lit(6).cast("long")).otherwise(one), "payload_bytes": F.length(content).cast("long") - F.col("payload_offset")})


def info(files: DataFrame, content: str = "content") -> DataFrame:
    """One line of text on each file."""
    known = described(files.withColumnRenamed(content, "bytes"), "bytes")
    name = F.coalesce("legacy_name", "dxgi_name", F.when(F.col("fourcc").isNotNull(), F.format_string("FOURCC=%d (Unknown)", "fourcc")), F.lit("UNSPECIFIED"))
    text = F.format_string("%s %dx%dx%d, %d levels, %d layers, %d faces, %d bytes", name, "width", "height", F.coalesce("depth", F.lit(1).cast("long")), "mips", "layers", "faces", "payload_bytes")
    return known.withColumn("info", F.when(F.col("height").isNull(), F.col("error")).otherwise(text)).select(*[c for c in files.columns if c != content], "info", "error")


def _listed(row: dict, mips: Iterator[int]) -> Iterator[tuple]:
    """(mip, layer, face, width, height, depth, offset, length or none, error) of one file's subresources, as its header counts them."""
    least, size0, stride = row["least"], row["size0"], row["stride"]
    for layer in range(row["layers"]):
        for face in range(row["faces"]):
            at = (layer * row["faces"] + face) * stride
            for mip in mips(row):
                length = max(size0 >> 2 * min(mip, 32), least) if mip else size0
                dims = [max(1, (row[k] or 1) >> min(mip, 32)) for k in ("width", "height", "depth")]
                error = "OutOfBounds" if at + length > containers.U32 else "TruncatedData" if at + length > row["payload_bytes"] else None
                yield (mip, layer, face, *dims, at, length, error)
                if error:
                    return
                at += length


_HELD = ("class", "hdr_content", "width", "height", "depth", "mips", "layers", "faces", "size0", "least", "stride", "payload_offset", "payload_bytes", "error")
DECODED = "mip long, layer long, face long, width long, height long, depth long, rgba binary, floats binary, error string"


def decode_files(files: DataFrame, key: str, content: str = "content", mip: int | None = None) -> DataFrame:
    """Every subresource (or those of one level) of each file as pixels: ``rgba`` bytes, or RGBA ``floats`` of HDR formats.

    A file's slices of one class are decoded by one call, and nothing of a file is copied to its
    subresources.  A file or subresource that cannot be decoded is one row with its error; the walk
    through a file ends at the first subresource that its payload does not hold, so that a header's
    claims cost nothing.
    """
    known = described(files.select(key, F.col(content).alias("bytes")), "bytes").select(key, "bytes", *_HELD)
    levels = (lambda row: range(row["mips"])) if mip is None else (lambda row: range(row["mips"]) if row["mips"] > mip else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = known_type
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_py() for c in _HELD}
                if row["error"] or row["class"] is None and row["hdr_content"] is None:
                    yield _rows(batch, i, key, kind, [(None,) * 8 + (row["error"] or "UnsupportedFormat",)])
                    continue
                data = batch.column("bytes")[i].as_buffer()
                listed = [x for x in _listed(row, levels) if mip is None or x[0] == mip or x[8]]
                done = []
                payload = lambda x: data.slice(row["payload_offset"] + x[6], x[7])  # noqa: E731, B023
                if row["class"] is None:
                    for x in listed:
                        px, error = (None, x[8]) if x[8] else blocks.decode_float(row["hdr_content"] == "bc6h_sf16", payload(x), *x[3:6])
                        done.append((*x[:6], None, px, error))
                else:
                    parts, at = [], []
                    for x in listed:
                        size = blocks.slice_bytes(row["class"], x[3], x[4])
                        at.append(len(parts))
                        if not x[8] and size * x[5] <= x[7]:
                            held = payload(x)
                            parts += [(held.slice(z * size, size), x[3], x[4]) for z in range(x[5])]
                    pixels = blocks.decode_many(row["class"], parts)
                    for x, a, b in zip(listed, at, [*at[1:], len(parts)], strict=True):
                        error = x[8] or (None if b > a else "TruncatedData")
                        done.append((*x[:6], None if error else b"".join(p for p, _ in pixels[a:b]), None, error))
                yield _rows(batch, i, key, kind, done)

    known_type = next(t for n, t in files.dtypes if n == key)
    return known.mapInArrow(run, f"`{key}` {known_type}, {DECODED}")


def _rows(batch: pa.RecordBatch, i: int, key: str, kind: str, rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64()] * 6 + [pa.binary(), pa.binary(), pa.string()]
    names = [x.split()[0] for x in DECODED.split(", ")]
    own = batch.column(key).take(pa.array([i] * len(rows), pa.int64()))
    return pa.RecordBatch.from_arrays([own, *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))] if rows else [own, *(pa.array([], t) for t in types)], [key, *names])


def block_row_ranges(surfaces_: DataFrame, at_once: int) -> DataFrame:
    """Independent parts (first_row, end_row) of each 2-D surface (class, width, height), ``at_once`` block rows each."""
    tall = F.when(F.col("class").isin("rgba8", "bgra8"), F.lit(1).cast("long")).otherwise(F.lit(4).cast("long"))
    rows = surfaces_.withColumn("block_rows", F.floor((F.col("height") + tall - 1) / tall).cast("long"))
    parts = rows.withColumn("first_row", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("block_rows") - 1, F.lit(0).cast("long")), F.lit(at_once).cast("long"))))
    return parts.withColumn("end_row", F.least(F.col("first_row") + at_once, F.col("block_rows")))


def decode_rows(parts: DataFrame) -> DataFrame:
    """``parts`` (class, payload, width, height, first_row, end_row) with the pixels of those block rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [batch.column(c).to_pylist() for c in ("class", "width", "height", "first_row", "end_row")]
            done = [blocks.decode_block_rows(c, batch.column("payload")[i].as_buffer(), w, h, a, b) for i, (c, w, h, a, b) in enumerate(zip(*held, strict=True))]
            rest = [c for c in batch.schema.names if c != "payload"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array([x for x, _ in done], pa.binary()), pa.array([e for _, e in done], pa.string())], [*rest, "rgba", "decode_error"])

    rest = parts.drop("payload")
    return parts.select(*rest.columns, "payload").mapInArrow(run, rest._jdf.schema().toDDL() + ", rgba binary, decode_error string")


def layout_error(width: Column, height: Column, depth: Column, mips: Column, layers: Column, is_cube: Column) -> Column:
    """What is wrong with an image's layout, if anything."""
    none = (width <= 0) | (height <= 0) | (depth <= 0) | (mips <= 0) | (layers <= 0)
    cube = is_cube & ((layers % 6 != 0) | (depth != 1))
    return F.when(none | cube | ((depth > 1) & (layers != 1)), "InvalidField")


def encode_files(images: DataFrame, key: str) -> DataFrame:
    """A container for each image (key, class, width, height, depth, mips, layers, is_cube, rgba): its bytes, or the error.

    ``rgba`` holds the slices of a volume or the layers (faces) of an array one behind the other.
    """
    spark = images.sparkSession
    of_name = {r["name"]: r for r in formats.dxgi_rows()}
    dim = spark.createDataFrame([(c, of_name[n]["code"], of_name[n]["bits_per_pixel"], of_name[n]["block_bytes"]) for c, n in WRITTEN.items()], "class string, dxgi bigint, bits bigint, block bigint")
    none = F.lit(None).cast("long")
    wanted = images.join(F.broadcast(dim), "class", "left").withColumn("layout_error", layout_error(*[F.col(c) for c in ("width", "height", "depth", "mips", "layers", "is_cube")]))
    wanted = wanted.withColumns({"packed": F.lit(False), "dimension": F.when(F.col("depth") > 1, F.lit(4).cast("long")).otherwise(F.lit(3).cast("long")), "alpha_mode": F.lit(1).cast("long"), "caps2": F.when(F.col("is_cube"), F.lit(_CUBE_ALL).cast("long")), "fourcc": none, **{f"{c}_mask": none for c in "rgba"}, "volume": F.col("depth"), "depth": F.when(F.col("depth") > 1, F.col("depth"))})
    made = containers.new_container(wanted)
    error = F.coalesce("layout_error", F.when(F.col("dxgi").isNull(), "UnsupportedFormat"), F.col("error"))
    ready = made.select(key, "class", "width", "height", F.col("volume").alias("depth"), "mips", "layers", "rgba", "header", error.alias("error"))
    kind = next(t for n, t in images.dtypes if n == key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                c, w, h, d, m, n, error = (batch.column(x)[i].as_py() for x in ("class", "width", "height", "depth", "mips", "layers", "error"))
                data = None
                if error is None:
                    data, error = encoders.encode_slices(c, batch.column("rgba")[i].as_buffer(), w, h, d, m, n)
                out.append((None if error else batch.column("header")[i].as_py() + data, error))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([x for x, _ in out], pa.binary()), pa.array([e for _, e in out], pa.string())], [key, "content", "error"])

    return ready.mapInArrow(run, f"`{key}` {kind}, content binary, error string")


