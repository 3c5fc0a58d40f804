"""Texture containers as rows: headers parsed and written by expressions over binary columns.

Every malformed file gives a row with ``error`` and null fields, never a failed task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.blocks import decode_many
from ..functions.formats import dxgi_rows

# The container's magic word, header sizes, and the word that announces the second header.
MAGIC, HEADER, PIXEL_FORMAT, DX10 = 0x20534444, 124, 32, 0x30315844
# Header flags, pixel-format flags, and the flags of cube maps.
F_PITCH, F_MIPS, F_LINEAR, F_DEPTH = 0x8, 0x20000, 0x80000, 0x800000
P_ALPHA_PIXELS, P_ALPHA, P_FOURCC, P_RGB, P_LUMINANCE = 0x1, 0x2, 0x4, 0x40, 0x20000
C_CUBE, M_CUBE = 0x200, 0x4
# The words of both headers, in file order after the magic word.
WORDS = ("size", "flags", "height", "width", "pitch_or_linear", "depth", "mips", *(f"reserved{i}" for i in range(11)), "pf_size", "pf_flags", "pf_fourcc", "pf_bits", "pf_r", "pf_g", "pf_b", "pf_a", "caps", "caps2", "caps3", "caps4", "reserved_last")
WORDS10 = ("dxgi", "dimension", "misc", "array_size", "alpha_mode")


# What the second header's numbers may be.
DIMENSIONS, ALPHA_MODES, FORCE_UINT = (0, 1, 2, 3, 4), (0, 1, 2, 3, 4), 0xFFFFFFFF


def word(data: Column | str, at: int) -> Column:
    """The unsigned little-endian 32-bit word at a byte offset; null beyond the end."""
    data = F.col(data) if isinstance(data, str) else data
    digits = F.hex(F.substring(data, at + 1, 4))
    turned = F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)])
    return F.when(F.length(digits) == 8, F.conv(turned, 16, 10).cast("long"))


def little(value: Column | int) -> Column:
    """Four bytes of an unsigned word, the lowest first."""
    value = F.lit(value).cast("long") if isinstance(value, int) else value
    digits = F.lpad(F.hex(value.cast("long")), 8, "0")
    return F.unhex(F.concat(*[F.substring(digits, i, 2) for i in (7, 5, 3, 1)]))


def _has(flags: Column, bit: int) -> Column:
    return flags.bitwiseAND(F.lit(bit).cast("long")) != 0


def parse(files: DataFrame, content: str = "content", known_formats: list[int] | None = None) -> DataFrame:
    """The header's fields, payload offset and error of each file's bytes; optional fields are null unless flagged."""
    raw = {"magic": word(content, 0)} | {f"w_{n}": word(content, 4 + 4 * i) for i, n in enumerate(WORDS)}
    out = files.withColumns(raw)
    dx10 = F.coalesce(_has(F.col("w_pf_flags"), P_FOURCC) & (F.col("w_pf_fourcc") == DX10), F.lit(False))
    out = out.withColumn("dx10", dx10).withColumns({n: F.when(F.col("dx10"), word(content, 128 + 4 * i)) for i, n in enumerate(WORDS10)})
    known = known_formats or [*(r["code"] for r in dxgi_rows()), FORCE_UINT]
    bad10 = F.col("dx10") & ~(F.col("dxgi").isin(known) & F.col("dimension").isin(*DIMENSIONS) & F.col("alpha_mode").isin(*ALPHA_MODES))
    error = (
        F.when(F.col("magic").isNull(), "Io").when(F.col("magic") != MAGIC, "BadMagic").when(F.col("w_size") != HEADER, "InvalidField")
        .when(F.col("w_pf_size") != PIXEL_FORMAT, "InvalidField").when(F.col("w_reserved_last").isNull(), "Io").when(F.col("dx10") & F.col("alpha_mode").isNull(), "Io").when(bad10, "InvalidField")
    )
    ok = lambda c, when=None: F.when(F.col("error").isNull() & (F.lit(True) if when is None else when), F.col(c))
    flags, pf = F.col("w_flags"), F.col("w_pf_flags")
    out = out.withColumn("error", error)
    fields = {
        "flags": ok("w_flags"), "height": ok("w_height"), "width": ok("w_width"), "pitch": ok("w_pitch_or_linear", _has(flags, F_PITCH)), "linear_size": ok("w_pitch_or_linear", _has(flags, F_LINEAR)),
        "depth": ok("w_depth", _has(flags, F_DEPTH)), "mip_map_count": ok("w_mips", _has(flags, F_MIPS)), "fourcc": ok("w_pf_fourcc", _has(pf, P_FOURCC)),
        "rgb_bit_count": ok("w_pf_bits", _has(pf, P_RGB) | _has(pf, P_LUMINANCE)), "r_mask": ok("w_pf_r", _has(pf, P_RGB)), "g_mask": ok("w_pf_g", _has(pf, P_RGB)), "b_mask": ok("w_pf_b", _has(pf, P_RGB)),
        "a_mask": ok("w_pf_a", _has(pf, P_ALPHA_PIXELS) | _has(pf, P_ALPHA)), "caps2": ok("w_caps2"), "payload_offset": F.when(F.col("error").isNull(), F.when(F.col("dx10"), 148).otherwise(128)),
        "is_cube": F.when(F.col("error").isNull(), F.when(F.col("dx10"), _has(F.col("misc"), M_CUBE)).otherwise(_has(F.col("w_caps2"), C_CUBE))),
    }
    kept = [*files.columns, *fields, *WORDS10, "error"]
    return out.withColumns(fields).select(*kept)


def compose(words: dict[str, Column | int], words10: dict[str, Column | int] | None, payload: Column) -> Column:
    """A file's bytes from its header words (missing ones are 0) and payload."""
    base = {"size": HEADER, "pf_size": PIXEL_FORMAT} | words
    parts = [little(MAGIC), *(little(base.get(n, 0)) for n in WORDS)]
    if words10 is not None:
        parts += [little(words10.get(n, 0)) for n in WORDS10]
    return F.concat(*parts, payload)


def read_dds(spark: SparkSession, path: str, max_payload: int | None = None) -> DataFrame:
    """path, content and parsed header of every file; larger ones than the limit are errors and not read."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "content")
    if max_payload is None:
        return parse(files)
    small = parse(files.where(F.col("length") <= max_payload + 148))
    over = F.col("length") - F.col("payload_offset") > max_payload
    large = spark.read.format("binaryFile").load(path).where(F.col("length") > max_payload + 148).select("path", "length")
    return small.withColumn("error", F.when(over, F.lit("SizeLimitExceeded")).otherwise(F.col("error"))).unionByName(large.withColumn("error", F.lit("SizeLimitExceeded")), allowMissingColumns=True)


def retag(content: Column | str, code: Column | int) -> Column:
    """The file with another format code in its second header."""
    data = F.col(content) if isinstance(content, str) else content
    return F.concat(F.substring(data, 1, 128), little(code), F.expr(f"substring({content}, 133)") if isinstance(content, str) else F.substring(data, 133, 1 << 30))


def decode(surfaces: DataFrame) -> DataFrame:
    """rgba and decode_error for each row (content, width, height, payload): one slice of an image; a batch's slices of one class go together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, rgba, errors = batch.column("content").to_pylist(), [None] * batch.num_rows, ["UnsupportedFormat"] * batch.num_rows
            sizes = list(zip(batch.column("width").to_pylist(), batch.column("height").to_pylist(), strict=True))
            by: dict[str, list[int]] = {}
            for i, name in enumerate(names):
                by.setdefault(name or "", []).append(i)
            for name, own in by.items():
                held = [batch.column("payload")[i].as_buffer() for i in own]
                for i, (px, error) in zip(own, decode_many(name, [(b if b is not None else b"", *(s or 0 for s in sizes[i])) for b, i in zip(held, own, strict=True)]), strict=True):
                    rgba[i], errors[i] = px, error
            rest = [c for c in batch.schema.names if c != "payload"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(rgba, pa.binary()), pa.array(errors, pa.string())], [*rest, "rgba", "decode_error"])

    rest = surfaces.drop("payload")
    return surfaces.select(*rest.columns, "payload").mapInArrow(run, rest._jdf.schema().toDDL() + ", rgba binary, decode_error string")


def write_dds(files: DataFrame, path: str) -> None:
    """A file for each row (name, content) in a folder that all executors share; a name written again by a retried task has the same bytes."""

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                with store.open_output_stream(f"{root}/{name}") as out:
                    out.write(content.as_buffer())
            yield pa.RecordBatch.from_arrays([batch.column("name")], ["name"])

    files.select("name", "content").mapInArrow(put, "name string").write.format("noop").mode("overwrite").save()
