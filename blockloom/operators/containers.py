"""What a container's header says of its payload, and headers for new ones, as expressions over columns.

All sizes are unsigned 32-bit numbers; what does not fit is null (no format can be meant by it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import legacy
from ..functions.palette import div
from ..sources import dds
from .surfaces import array_stride

U32 = 0xFFFFFFFF
# Header flags of every file, and those of levels, depth, sizes; capabilities.
FLAGS, CAPS = 0x1007, 0x1000
C_COMPLEX, C_MIPMAP = 0x8, 0x400000


def checked(value: Column) -> Column:
    return F.when(value.between(0, U32), value)


def times(a: Column, b: Column) -> Column:
    return checked(F.try_multiply(a, b))


def pitch(width: Column, bits: Column, block: Column, packed: Column) -> Column:
    """Bytes of a row (of blocks): packed pairs, whole bytes of pixels, or four pixels a block."""
    pairs = times(div(checked(width + 1), 2), F.lit(4).cast("long"))
    plain = div(checked(times(width, bits) + 7), 8)
    blocks = times(F.greatest(div(checked(width + 3), 4), F.lit(1).cast("long")), block)
    return F.when(packed, pairs).when(bits.isNotNull(), plain).when(F.col("width").isNotNull() & block.isNotNull(), F.when(checked(width + 3).isNotNull(), blocks))


def pitch_height(block: Column) -> Column:
    return F.when(block.isNotNull(), F.lit(4).cast("long")).otherwise(F.lit(1).cast("long"))


def least_bytes(bits: Column, block: Column) -> Column:
    """Bytes of the smallest level: a block, or a pixel in whole bytes."""
    return F.coalesce(div(bits + 7, 8), block)


def texture_size(row_bytes: Column, linear_size: Column, row_height: Column, height: Column, depth: Column) -> Column:
    """Bytes of the first level: what the header says, else rows times pitch times depth."""
    rows = div(checked(height + row_height - 1), row_height)
    return F.coalesce(linear_size, times(times(row_bytes, rows), F.coalesce(depth, F.lit(1).cast("long"))))


def metrics(headers: DataFrame) -> DataFrame:
    """Sizes of each container (width, height, depth, pitch, linear_size, mip_map_count, rgb_bit_count, array_size, is_cube, dx10; bits, block, packed of its format, all null if unknown).

    Adds bits_per_pixel, row_bytes, row_height, size0, least, mips, layers, stride and error.
    """
    bits = F.coalesce("bits", "rgb_bit_count")
    of_format = pitch(F.col("width"), F.col("bits"), F.col("block"), F.coalesce("packed", F.lit(False)))
    out = headers.withColumns({
        "bits_per_pixel": bits, "row_bytes": F.coalesce(of_format, F.col("pitch"), div(checked(times(bits, F.col("width")) + 7), 8)), "row_height": pitch_height(F.col("block")),
        "least": F.coalesce(least_bytes(F.col("bits"), F.col("block")), div(F.when(bits + 7 > U32, F.lit(U32)).otherwise(bits + 7), 8), F.lit(1).cast("long")), "mips": F.coalesce("mip_map_count", F.lit(1).cast("long")),
        "layers": F.when(F.col("dx10"), F.col("array_size")).when(F.col("is_cube"), F.lit(6).cast("long")).otherwise(F.lit(1).cast("long")),
    })
    out = out.withColumn("size0", texture_size(F.col("row_bytes"), F.col("linear_size"), F.col("row_height"), F.col("height"), F.col("depth")))
    return out.withColumn("stride", F.when(F.col("size0").isNotNull(), array_stride())).withColumn("error", F.when(F.col("size0").isNull(), "UnsupportedFormat"))


def layer_range(sized: DataFrame, layer: Column) -> DataFrame:
    """Offset and length of a layer's chain in the payload (payload_bytes), or the error."""
    start = times(layer, F.col("stride"))
    past = (layer >= F.col("layers")) | start.isNull() | (start + F.col("stride") > F.col("payload_bytes"))
    error = F.when(layer >= F.col("layers"), "OutOfBounds").otherwise(F.coalesce("error", F.when(past, "OutOfBounds")))
    return sized.withColumn("layer", layer).withColumn("error", error).withColumns({"offset": F.when(F.col("error").isNull(), start), "length": F.when(F.col("error").isNull(), F.col("stride"))})


def layer_data(payload: Column, offset: Column, length: Column) -> Column:
    return F.when(offset.isNotNull(), F.substring(payload, (offset + 1).cast("int"), length.cast("int")))


def legacy_format(headers: DataFrame) -> DataFrame:
    """The legacy format's row (name, bits_per_pixel, block_bytes, content) of each pixel format (fourcc, pf_flags, rgb_bit_count, masks).

    Four characters decide where there are any; else flags, bits and masks must all be as the format has them.
    """
    spark = headers.sparkSession
    formats = spark.createDataFrame([tuple(r.values()) for r in legacy.rows()], legacy.DDL)
    coded = formats.where("fourcc is not null").select(F.col("fourcc").alias("code"), F.col("name").alias("by_code"))
    keys = spark.createDataFrame([tuple(r.values()) for r in legacy.mask_keys()], legacy.KEY_DDL)
    has = lambda *bits: F.greatest(*[F.col("pf_flags").bitwiseAND(F.lit(b).cast("long")) for b in (*bits, 0)]) > 0
    told = headers.withColumns({"says_luminance": has(dds.P_LUMINANCE), "says_rgb": has(dds.P_RGB), "says_alpha": has(dds.P_ALPHA, dds.P_ALPHA_PIXELS)})
    same = "fourcc is null and says_luminance = k.luminance and says_rgb = k.rgb and says_alpha = k.alpha and rgb_bit_count <=> k.bits and h.r_mask <=> k.r_mask and h.g_mask <=> k.g_mask and h.b_mask <=> k.b_mask and h.a_mask <=> k.a_mask"
    by_mask = told.alias("h").join(F.broadcast(keys.alias("k")), F.expr(same), "left").select("h.*", F.col("k.name").alias("by_mask"))
    named = by_mask.join(F.broadcast(coded), F.col("fourcc") == F.col("code"), "left").withColumn("name", F.coalesce("by_code", "by_mask"))
    rest = formats.select("name", "bits_per_pixel", "block_bytes", "content")
    return named.drop("says_luminance", "says_rgb", "says_alpha", "by_mask", "by_code", "code").join(F.broadcast(rest), "name", "left")


def new_container(wanted: DataFrame) -> DataFrame:
    """Header bytes, payload length or error of new containers (width, height, depth, mips, layers, is_cube, dimension, alpha_mode, caps2; dxgi or null, fourcc, masks, bits, block, packed).

    A code in ``dxgi`` makes a second header, else the legacy pixel format is written.
    """
    depth, mips = F.coalesce("depth", F.lit(1).cast("long")), F.coalesce("mips", F.lit(1).cast("long"))
    bits, block, dx10 = F.col("bits"), F.col("block"), F.col("dxgi").isNotNull()
    rows = wanted.withColumns({"row_bytes": pitch(F.col("width"), bits, block, F.col("packed")), "row_height": pitch_height(block), "least": least_bytes(bits, block), "levels": mips, "slices": F.when(dx10, F.coalesce("layers", F.lit(1).cast("long"))).otherwise(F.lit(1).cast("long"))})
    rows = rows.withColumn("size0", texture_size(F.col("row_bytes"), F.lit(None).cast("long"), F.col("row_height"), F.col("height"), F.col("depth")))
    rows = rows.withColumn("stride", array_stride(mips="levels")).withColumn("data_bytes", times(F.col("slices"), F.col("stride")))
    error = F.when(F.col("size0").isNull() | F.col("least").isNull(), "UnsupportedFormat").when(F.col("data_bytes").isNull(), "OutOfBounds")
    flag = lambda when, bit: F.when(F.coalesce(when, F.lit(False)), F.lit(bit)).otherwise(F.lit(0)).cast("long")
    either = lambda *parts: F.aggregate(F.array(*parts), F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    many = F.col("levels") > 1
    words = {
        "flags": either(F.lit(FLAGS).cast("long"), flag(many, dds.F_MIPS), flag(depth > 1, dds.F_DEPTH), flag(block.isNotNull(), dds.F_LINEAR), flag(block.isNull(), dds.F_PITCH)),
        "height": F.col("height"), "width": F.col("width"), "pitch_or_linear": F.when(block.isNull(), F.col("row_bytes")).otherwise(F.col("size0")), "depth": F.coalesce("depth", F.lit(0).cast("long")),
        "mips": F.coalesce("mips", F.lit(0).cast("long")), "pf_flags": either(flag(bits.isNotNull(), dds.P_RGB), flag(dx10 | bits.isNull(), dds.P_FOURCC), flag(~dx10 & F.col("a_mask").isNotNull(), dds.P_ALPHA_PIXELS)),
        "pf_fourcc": F.when(dx10, F.lit(dds.DX10).cast("long")).when(bits.isNull(), F.col("fourcc")).otherwise(F.lit(0).cast("long")), "pf_bits": F.coalesce("bits", F.lit(0).cast("long")),
        **{f"pf_{c}": F.when(dx10, F.lit(0).cast("long")).otherwise(F.coalesce(f"{c}_mask", F.lit(0).cast("long"))) for c in "rgba"},
        "caps": either(F.lit(CAPS).cast("long"), flag(many, C_COMPLEX | C_MIPMAP), flag(depth > 1, C_COMPLEX), flag(dx10 & (F.coalesce("layers", F.lit(1).cast("long")) > 1), C_COMPLEX)), "caps2": F.coalesce("caps2", F.lit(0).cast("long")),
    }
    words10 = {"dxgi": F.col("dxgi"), "dimension": F.col("dimension"), "misc": flag(F.col("is_cube"), dds.M_CUBE), "array_size": F.when(F.col("is_cube"), div(F.col("slices"), 6)).otherwise(F.col("slices")), "alpha_mode": F.col("alpha_mode")}
    empty = F.unhex(F.lit(""))
    header = F.when(dx10, dds.compose(words, words10, empty)).otherwise(dds.compose(words, None, empty))
    return rows.withColumn("error", error).withColumns({"header": F.when(F.col("error").isNull(), header), "data_bytes": F.when(F.col("error").isNull(), F.col("data_bytes"))})
