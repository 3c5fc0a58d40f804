"""Subresource addressing and upload plans: generators and prefix sums without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.palette import div, mip_size, payload_bytes

#: Levels beyond which every further one has the least size: a 32-bit size has been quartered to nothing.
TAIL = 17


def mip_chain(textures: DataFrame, least: str = "least") -> DataFrame:
    """One row for each level of each texture (width, height, mips, size0, least): dimensions, offset and length.

    Offsets are prefix sums of the level sizes, computed inside the row.
    """
    sizes = F.transform(F.sequence(F.lit(0).cast("long"), F.col("mips") - 1), lambda k: mip_size(F.col("size0"), k, F.col(least)))
    some = textures.where("mips > 0").withColumn("sizes", sizes)
    rows = some.select("*", F.posexplode("sizes").alias("mip", "length"))
    before = F.aggregate(F.slice("sizes", F.lit(1), F.col("mip")), F.lit(0).cast("long"), lambda a, x: a + x)
    half = lambda c: F.greatest(F.lit(1).cast("long"), F.call_function("shiftright", F.col(c), F.col("mip")))
    return rows.withColumns({"mip": F.col("mip").cast("long"), "offset": before, "mip_width": half("width"), "mip_height": half("height")}).drop("sizes")


def array_stride(size0: str = "size0", mips: str = "mips", least: str = "least", limit: int = 0xFFFFFFFF) -> Column:
    """Bytes of a whole chain, saturating at 32 bits; the tail of least-size levels in closed form."""
    n = F.least(F.col(mips), F.lit(TAIL))
    head = F.aggregate(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: mip_size(F.col(size0), k, F.col(least))), F.lit(0).cast("long"), lambda a, x: a + x)
    tail = F.greatest(F.col(mips) - TAIL, F.lit(0)) * F.col(least)
    return F.when(F.col(mips) <= 0, F.lit(0).cast("long")).otherwise(F.least(head + tail, F.lit(limit)))


def upload_plan(levels: DataFrame) -> DataFrame:
    """bytes_per_row and rows_per_image of each level (mip_width, mip_height, block_bytes), and its decoded length."""
    block = F.col("block_bytes")
    row = F.coalesce(div(F.col("mip_width") + 3, 4) * block, F.col("mip_width") * 4)
    rows = F.when(block.isNotNull(), div(F.col("mip_height") + 3, 4)).otherwise(F.col("mip_height"))
    return levels.withColumns({"bytes_per_row": row, "rows_per_image": rows, "decoded_bytes": F.col("mip_width") * F.col("mip_height") * 4, "needed": payload_bytes("mip_width", "mip_height", "block_bytes")})


def subresources(textures: DataFrame) -> DataFrame:
    """One row for each layer, face and level of each texture (width, height, mips, size0, least, layers, faces, payload_bytes).

    ``offset`` counts whole chains before the level's own; a range past the payload's end has the
    error TruncatedData.  A header may claim up to 2**32 slices, so they are listed in two steps,
    no row holding more than a few thousand of them at once.
    """
    slices = F.col("layers") * F.col("faces")
    listed = textures.where(slices > 0).withColumns({"stride": array_stride(), "claimed": slices})
    parts = listed.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), div(F.col("claimed") - 1, 1 << 12))))
    first = F.col("part") * (1 << 12)
    rows = parts.withColumn("physical_slice", F.explode(F.sequence(first, F.least(first + (1 << 12), F.col("claimed")) - 1))).drop("part")
    levels = mip_chain(rows)
    at = F.col("physical_slice") * F.col("stride") + F.col("offset")
    out = levels.withColumns({"layer": div(F.col("physical_slice"), F.col("faces")), "face": F.col("physical_slice") % F.col("faces"), "offset": at})
    return out.withColumn("error", F.when(F.col("offset") + F.col("length") > F.col("payload_bytes"), "TruncatedData"))


def replace_range(payload, offset, length, data) -> Column:
    """The payload with ``length`` bytes from ``offset`` on replaced."""
    return F.overlay(payload, data, offset + 1, length)
