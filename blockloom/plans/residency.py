"""Texture requests of a moving camera: the distance join, its mip tail, and the demand it makes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.palette import payload_bytes

#: No request beyond this distance; full detail up to that one.
CULL, NEAR = 260, 40


def cells(world: DataFrame, size: int = CULL) -> DataFrame:
    return world.withColumns({"cx": F.floor(F.col("x") / size).cast("long"), "cz": F.floor(F.col("z") / size).cast("long")})


def requests(world: DataFrame, cameras: DataFrame, bias: float = 0.0) -> DataFrame:
    """(frame, tex, mip) of every texture within the cull distance of a frame's camera, from its wanted mip to the last.

    The distance join is an equality join on grid cells of the cull distance (each camera reaches
    nine of them), then the exact test, so it does not compare all textures with all frames.
    Heights (y, cam_y) count where both tables have them.
    """
    near = F.explode(F.sequence(F.lit(-1).cast("long"), F.lit(1).cast("long")))
    tall = "y" in world.columns and "cam_y" in cameras.columns
    eyes = cells(cameras.select("frame", F.col("cam_x").alias("x"), F.col("cam_z").alias("z"), (F.col("cam_y") if tall else F.lit(0)).alias("cam_y"))).withColumn("dx", near).withColumn("dz", near)
    eyes = eyes.select("frame", F.col("x").alias("cam_x"), F.col("z").alias("cam_z"), "cam_y", (F.col("cx") + F.col("dx")).alias("cx"), (F.col("cz") + F.col("dz")).alias("cz"))
    squared = (F.col("x") - F.col("cam_x")) * (F.col("x") - F.col("cam_x")) + (F.col("z") - F.col("cam_z")) * (F.col("z") - F.col("cam_z"))
    squared = squared + (F.col("y") - F.col("cam_y")) * (F.col("y") - F.col("cam_y")) if tall else squared
    seen = cells(world).join(eyes, ["cx", "cz"]).withColumn("d2", squared).where(F.col("d2") <= CULL * CULL)
    top = F.least(F.round(F.greatest(F.log2(F.greatest(F.sqrt("d2") / NEAR, F.lit(1.0))) + bias, F.lit(0.0))).cast("long"), F.col("mips") - 1)
    return seen.where("mips > 0").select("frame", "tex", F.explode(F.sequence(top, F.col("mips") - 1)).alias("mip"))


def level_bytes(size: Column, mip: Column, block_bytes: Column) -> Column:
    """Exact bytes of a square level: whole blocks of its own size."""
    w = F.greatest(F.call_function("shiftright", size, mip.cast("int")), F.lit(1))
    return payload_bytes(w, w, block_bytes)


def peak_demand(wanted: DataFrame) -> DataFrame:
    """The largest sum of a frame's bytes."""
    return wanted.groupBy("frame").agg(F.sum("bytes").alias("bytes")).agg(F.max("bytes").alias("peak_bytes"))
