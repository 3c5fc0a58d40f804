"""Scenarios, quality tiers, the seeded world, scripted cameras and request hashes of the streaming simulator."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashes import OFFSET, PRIME

# Name, camera kind, frames, seconds a frame, warm-up frames.
SCENARIOS = [("traverse", "traverse", 10800, 1 / 60, 300), ("arrival", "arrival", 12000, 1 / 60, 300), ("hub", "hub", 18000, 1 / 60, 300), ("soak", "soak", 108000, 1 / 60, 600), ("mission", "mission", 32400, 1 / 60, 300), ("smoke", "traverse", 600, 1 / 60, 60)]
# Tier, texture size, lambda, mip bias, pool pressure, pool share, upload budget in MiB.
TIERS = [("ultra", 2048, 0.0, 0.0, 0.80, 0.16, 12), ("high", 1024, 4.0, 0.0, 0.65, 0.13, 8), ("medium", 512, 10.0, 1.0, 0.50, 0.10, 6)]
# The world's half extent, and its height.
EXTENT, HEIGHT = 300.0, 6.0
# Seeds of the cameras' jumps, and SplitMix64's increment and multipliers.
ARRIVAL, MISSION, JUMP = 0xA2211AA0, 0x51551043, 0xD06E5EED
GOLDEN, M1, M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB
LEG = 1800
_f = np.float32


def scenarios(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCENARIOS, "name string, kind string, frames long, dt double, warmup long")


def tiers(spark: SparkSession) -> DataFrame:
    rows = spark.createDataFrame(TIERS, "tier string, size long, lambda double, mip_bias double, pressure double, pool_share double, budget_mib long")
    return rows.withColumn("upload_budget", F.col("budget_mib") * (1 << 20)).drop("budget_mib")


def contents(textures: DataFrame) -> DataFrame:
    """The content class of each texture (tier, tex): one in sixteen is HDR but in the lowest tier, then colour, normals and masks."""
    tier, i = F.col("tier"), F.col("tex")
    colour = F.when(tier == "ultra", "bc7").when(i % 8 < 4, F.when(tier == "high", "bc7").otherwise("bc1")).otherwise(F.when(tier == "high", "bc1").otherwise("bc3"))
    plain = F.when(i % 4 < 2, colour).when(i % 4 == 2, "bc5u").otherwise("bc4u")
    return textures.withColumn("content", F.when((tier != "medium") & (i % 16 == 8), "bc6h").otherwise(plain))


def reported(frames: DataFrame, warmup: int) -> DataFrame:
    return frames.where(F.col("frame") >= warmup)


def draws(seed: np.ndarray | int, k: np.ndarray) -> np.ndarray:
    """The k-th numbers of the seeded generator: its state is a counter, so any draw is made by itself."""
    z = np.asarray(seed, np.uint64) + np.uint64(GOLDEN) * (k.astype(np.uint64) + np.uint64(2))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(M1)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(M2)
    return z ^ (z >> np.uint64(31))


def between(drawn: np.ndarray, low: float, high: float) -> np.ndarray:
    """Draws as single floats from low to below high."""
    part = (drawn >> np.uint64(40)).astype(_f) / _f(1 << 24)
    return _f(low) + part * (_f(high) - _f(low))


def world(textures: DataFrame, seed: int) -> DataFrame:
    """``textures`` (tex from 0 on, ...) with their places x, y, z."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 3 * np.asarray(batch.column("tex"))
            for name, k, half in (("x", 0, EXTENT), ("y", 1, HEIGHT), ("z", 2, EXTENT)):
                batch = batch.append_column(name, pa.array(between(draws(seed, at + k), -half, half).astype(np.float64)))
            yield batch

    return textures.mapInArrow(run, f"{textures._jdf.schema().toDDL()}, x double, y double, z double")


def camera(kind: str, frame: np.ndarray, dt: float) -> tuple[np.ndarray, np.ndarray]:
    """x and z of the scripted camera at each frame, in single floats (its height is 0)."""
    frame, dt, wide = frame.astype(np.int64), _f(dt), _f(EXTENT) * _f(0.8)
    t = frame.astype(_f) * dt
    spot = lambda seed, half: (between(draws(seed, np.zeros(len(seed), np.int64)), -half, half), between(draws(seed, np.ones(len(seed), np.int64)), -half, half))
    if kind in ("traverse", "soak"):
        return wide * np.sin(t * _f(0.35)), wide * np.cos(t * _f(0.2149))
    if kind == "hub":
        return _f(70) * np.cos(t * _f(0.6)), _f(70) * np.sin(t * _f(0.6))
    if kind == "arrival":
        x, z = spot(np.uint64(ARRIVAL) ^ (frame // 1200).astype(np.uint64), EXTENT)
        local = (frame % 1200).astype(_f) * dt
        return x + local * _f(14), z + local * _f(5)
    if kind != "mission":
        raise ValueError(f"no camera of kind {kind}")
    lap, leg = frame // (6 * LEG), frame % (6 * LEG) // LEG
    lt, one, half = (frame % LEG).astype(_f) * dt, _f(1), _f(EXTENT) * _f(0.6)
    x, z = spot(np.uint64(MISSION) ^ lap.astype(np.uint64), float(half))
    jump_x, jump_z = spot(np.uint64(JUMP) ^ (lap.astype(np.uint64) << np.uint64(8)), EXTENT)
    far, gone = _f(0.28) * lt * lt, lt / _f(30)
    left = (one - gone) ** 3
    left = one - (one - left)
    phase = lap.astype(_f)
    xs = [x + _f(18) * np.cos(lt * _f(0.25)), x + far, wide * np.sin(lt * _f(0.35) + phase), jump_x + left * _f(150), x + _f(60) + _f(9) * np.cos(lt * _f(0.5)), x + _f(60) * (one - gone)]
    zs = [z + _f(18) * np.sin(lt * _f(0.25)), z + far * _f(0.4), wide * np.cos(lt * _f(0.2149) + phase), jump_z + left * _f(60), z + _f(24) + _f(9) * np.sin(lt * _f(0.5)), z + _f(24) * (one - gone)]
    return np.choose(leg, xs), np.choose(leg, zs)


def cameras(frames: DataFrame, kind: str, dt: float) -> DataFrame:
    """frame, cam_x, cam_y, cam_z of each row of ``frames`` (frame)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, z = camera(kind, np.asarray(batch.column("frame")), dt)
            yield pa.RecordBatch.from_arrays([batch.column("frame"), pa.array(x.astype(np.float64)), pa.array(np.zeros(len(x))), pa.array(z.astype(np.float64))], ["frame", "cam_x", "cam_y", "cam_z"])

    return frames.select(F.col("frame").cast("long").alias("frame")).mapInArrow(run, "frame long, cam_x double, cam_y double, cam_z double")


def mixed(h: int, value: int) -> int:
    """A hash with the eight bytes of a value folded in."""
    for b in value.to_bytes(8, "little"):
        h = (h ^ b) * PRIME & 0xFFFFFFFFFFFFFFFF
    return h


def request_hashes(requests: DataFrame) -> DataFrame:
    """frame and request_hash (16 hex digits): the frame's requests folded in order of texture and mip.

    A frame has at most the world's textures and levels, which is what one group holds.
    """

    def run(key: tuple, table: pa.Table) -> pa.Table:
        h = OFFSET
        for tex, mip in sorted(zip(table.column("tex").to_pylist(), table.column("mip").to_pylist(), strict=True)):
            h = mixed(h, tex << 32 | mip)
        return pa.table({"frame": pa.array([key[0].as_py()], pa.int64()), "request_hash": pa.array([f"{h:016x}"])})

    return requests.select("frame", "tex", "mip").groupBy("frame").applyInArrow(run, "frame long, request_hash string")
