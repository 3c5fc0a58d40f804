"""Queries over container headers: legacy formats, sizes, layers, and headers of new containers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, legacy
from ..operators import containers
from . import views
from .catalog import _query, _values

_U32 = "4294967295"


def _formats() -> list[tuple]:
    """id, dxgi code or null, bits, block, packed, fourcc and masks of every format of both kinds."""
    out = [(i, r["code"], r["bits_per_pixel"], r["block_bytes"], r["name"] in legacy.PACKED, None, None, None, None, None) for i, r in enumerate(formats.dxgi_rows())]
    out += [(len(out) + i, None, r["bits_per_pixel"], r["block_bytes"], r["name"] in legacy.PACKED, r["fourcc"], *(r[f"{c}_mask"] for c in "rgba")) for i, r in enumerate(legacy.rows())]
    return out


_FORMAT_DDL = "fid bigint, dxgi bigint, bits bigint, block bigint, packed boolean, fourcc bigint, r_mask bigint, g_mask bigint, b_mask bigint, a_mask bigint"
_FORMAT_SQL = f"(SELECT * FROM (VALUES {_values(_formats())}) AS f(fid, dxgi, bits, block, packed, fourcc, r_mask, g_mask, b_mask, a_mask))"
_N = len(_formats())
_HEADS = f"""SELECT p_partkey AS tex, p_partkey % {_N + 3} AS fid, CASE WHEN p_partkey % 11 = 0 THEN {_U32} - p_partkey % 5 ELSE p_size * 3 + 1 END AS width,
  CASE WHEN p_partkey % 13 = 0 THEN 70000 * p_size ELSE p_size * 2 + 1 END AS height, CASE WHEN p_partkey % 3 = 0 THEN 1 + p_partkey % 4 END AS depth, CASE WHEN p_partkey % 5 = 0 THEN 4096 + p_partkey % 7 END AS pitch,
  CASE WHEN p_partkey % 7 = 0 THEN 65536 + p_partkey END AS linear_size, CASE WHEN p_partkey % 4 <> 0 THEN p_partkey % 40 END AS mip_map_count, CASE WHEN p_partkey % 17 = 0 THEN p_partkey % 100 END AS rgb_bit_count,
  p_partkey % 2 = 0 AS dx10, p_partkey % 6 = 1 AS is_cube, p_partkey % 9 AS array_size, CASE WHEN p_partkey % 4 <> 0 THEN 1 + p_partkey % 3 END AS layers FROM part"""


def _heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = views._view(spark, sf_dir, "part", _HEADS)
    return heads.select(*[F.col(c) if t == "boolean" else F.col(c).cast("long").alias(c) for c, t in heads.dtypes])


def _dim(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(_formats(), _FORMAT_DDL))


def _fits(x: str) -> str:
    return f"CASE WHEN ({x}) <= {_U32} THEN {x} END"


_WIDE = "width::HUGEINT"
_OF_FORMAT = f"""CASE WHEN packed AND bits IS NOT NULL THEN {_fits(f"CASE WHEN {_WIDE} + 1 <= {_U32} THEN ({_WIDE} + 1) // 2 * 4 END")} WHEN bits IS NOT NULL THEN CASE WHEN {_WIDE} * bits + 7 <= {_U32} THEN ({_WIDE} * bits + 7) // 8 END
  WHEN block IS NOT NULL THEN CASE WHEN {_WIDE} + 3 <= {_U32} THEN {_fits(f"GREATEST(1, ({_WIDE} + 3) // 4) * block")} END END"""
_ROWS = "(height::HUGEINT + row_height - 1) // row_height"


def _chain(size: str, least: str, levels: str) -> str:
    """Bytes of a chain: each level a quarter of the one before, not below the least; the sum ends at 32 bits."""
    return f"LEAST({_U32}, CASE WHEN {levels} <= 0 THEN 0 ELSE list_sum(list_transform(range(LEAST({levels}, 17)::BIGINT), lambda k: GREATEST(({size})::BIGINT >> (2 * k), {least})::HUGEINT)) + GREATEST({levels} - 17, 0) * {least} END)::BIGINT"


_METRICS = f"""a AS (SELECT h.*, f.bits, f.block, f.packed, COALESCE(f.bits, rgb_bit_count) AS bits_per_pixel FROM ({_HEADS}) h LEFT JOIN {_FORMAT_SQL} f USING (fid)),
b AS (SELECT *, COALESCE({_OF_FORMAT}, pitch, CASE WHEN {_WIDE} * bits_per_pixel + 7 <= {_U32} THEN ({_WIDE} * bits_per_pixel + 7) // 8 END)::BIGINT AS row_bytes, CASE WHEN block IS NULL THEN 1 ELSE 4 END AS row_height,
  COALESCE((bits + 7) // 8, block, (rgb_bit_count + 7) // 8, 1)::BIGINT AS least, COALESCE(mip_map_count, 1) AS mips, CASE WHEN dx10 THEN array_size WHEN is_cube THEN 6 ELSE 1 END AS n_layers FROM a),
c AS (SELECT *, COALESCE(linear_size, CASE WHEN row_bytes * ({_ROWS}) <= {_U32} THEN {_fits(f"row_bytes * ({_ROWS}) * COALESCE(depth, 1)")} END)::BIGINT AS size0 FROM b),
d AS (SELECT *, CASE WHEN size0 IS NOT NULL THEN {_chain("size0", "least", "mips")} END AS stride FROM c)"""


@_query(f"WITH {_METRICS} SELECT tex, bits_per_pixel::BIGINT AS bits_per_pixel, row_bytes, row_height::BIGINT AS row_height, size0, least, mips::BIGINT AS mips, n_layers::BIGINT AS layers, stride, CASE WHEN size0 IS NULL THEN 'UnsupportedFormat' END AS error FROM d")
def container_metrics(spark, sf_dir):
    """Pitch, first level, stride and counts of each header, formats of both kinds and unknown ones, widths up to 32 bits."""
    heads = _heads(spark, sf_dir).drop("layers").join(_dim(spark).drop("fourcc", "dxgi", "r_mask", "g_mask", "b_mask", "a_mask"), "fid", "left")
    return containers.metrics(heads).select("tex", "bits_per_pixel", "row_bytes", "row_height", "size0", "least", "mips", "layers", "stride", "error")


@_query(f"""WITH {_METRICS}, e AS (SELECT *, tex % 8 AS layer, stride * n_layers - tex % 3 AS payload_bytes FROM d),
g AS (SELECT *, CASE WHEN layer >= n_layers THEN 'OutOfBounds' WHEN size0 IS NULL THEN 'UnsupportedFormat' WHEN layer::HUGEINT * stride > {_U32} OR layer::HUGEINT * stride + stride > payload_bytes THEN 'OutOfBounds' END AS error FROM e)
SELECT tex, layer, CASE WHEN error IS NULL THEN layer * stride END::BIGINT AS "offset", CASE WHEN error IS NULL THEN stride END AS length, error FROM g""")
def layer_ranges(spark, sf_dir):
    heads = _heads(spark, sf_dir).drop("layers").join(_dim(spark).drop("fourcc", "dxgi", "r_mask", "g_mask", "b_mask", "a_mask"), "fid", "left")
    sized = containers.metrics(heads).withColumn("payload_bytes", F.col("stride") * F.col("layers") - F.col("tex") % 3)
    return containers.layer_range(sized, F.col("tex") % 8).select("tex", "layer", "offset", "length", "error")


def _le(x: str) -> str:
    h = f"lpad(lower(to_hex(({x})::BIGINT)), 8, '0')"
    return " || ".join(f"substr({h}, {i}, 2)" for i in (7, 5, 3, 1))


_NEW_WORDS = ["542327876", "124", "4103 + CASE WHEN levels > 1 THEN 131072 ELSE 0 END + CASE WHEN depth > 1 THEN 8388608 ELSE 0 END + CASE WHEN block IS NULL THEN 8 ELSE 524288 END", "height", "width", "CASE WHEN block IS NULL THEN row_bytes ELSE size0 END", "COALESCE(depth, 0)", "COALESCE(mip_map_count, 0)", *["0"] * 11,
              "32", "CASE WHEN bits IS NULL THEN 0 ELSE 64 END + CASE WHEN dxgi IS NOT NULL OR bits IS NULL THEN 4 ELSE 0 END + CASE WHEN a_mask IS NULL THEN 0 ELSE 1 END", "CASE WHEN dxgi IS NOT NULL THEN 808540228 WHEN bits IS NULL THEN fourcc ELSE 0 END", "COALESCE(bits, 0)", *[f"COALESCE({c}_mask, 0)" for c in "rgba"],
              "4096 + CASE WHEN levels > 1 THEN 4194304 ELSE 0 END + CASE WHEN levels > 1 OR depth > 1 OR (dxgi IS NOT NULL AND layers > 1) THEN 8 ELSE 0 END", "CASE WHEN is_cube THEN 65024 ELSE 0 END", "0", "0", "0"]
_NEW_WORDS10 = ["dxgi", "3", "CASE WHEN is_cube THEN 4 ELSE 0 END", "CASE WHEN is_cube THEN slices // 6 ELSE slices END", "0"]


@_query(f"""WITH a AS (SELECT h.*, f.* EXCLUDE (fid) FROM ({_HEADS}) h JOIN {_FORMAT_SQL} f USING (fid)),
b AS (SELECT *, {_OF_FORMAT} AS row_bytes, CASE WHEN block IS NULL THEN 1 ELSE 4 END AS row_height, COALESCE((bits + 7) // 8, block) AS least, COALESCE(mip_map_count, 1) AS levels, CASE WHEN dxgi IS NULL THEN 1 ELSE COALESCE(layers, 1) END AS slices FROM a),
c AS (SELECT *, CASE WHEN row_bytes * ({_ROWS}) <= {_U32} THEN {_fits(f"row_bytes * ({_ROWS}) * COALESCE(depth, 1)")} END::BIGINT AS size0 FROM b),
d AS (SELECT *, CASE WHEN size0 IS NOT NULL THEN {_chain("size0", "least", "levels")} END AS stride FROM c),
e AS (SELECT *, CASE WHEN size0 IS NULL OR least IS NULL THEN 'UnsupportedFormat' WHEN stride::HUGEINT * slices > {_U32} THEN 'OutOfBounds' END AS error FROM d)
SELECT tex, CASE WHEN error IS NULL THEN {" || ".join(map(_le, _NEW_WORDS))} || CASE WHEN dxgi IS NULL THEN '' ELSE {" || ".join(map(_le, _NEW_WORDS10))} END END AS header, CASE WHEN error IS NULL THEN stride * slices END::BIGINT AS data_bytes, error FROM e""")
def new_containers(spark, sf_dir):
    """Headers of new containers in every format, with levels, depth, layers and cube faces, as bytes."""
    heads = _heads(spark, sf_dir).join(_dim(spark), "fid").withColumnRenamed("mip_map_count", "mips")
    made = containers.new_container(heads.withColumns({"dimension": F.lit(3).cast("long"), "alpha_mode": F.lit(0).cast("long"), "caps2": F.when(F.col("is_cube"), F.lit(0xFE00).cast("long"))}))
    return made.select("tex", F.lower(F.hex("header")).alias("header"), "data_bytes", "error")


_LEGACY_SQL = "(SELECT * FROM (VALUES " + _values([tuple(r.values()) for r in legacy.rows()]) + ") AS f(name, bits_per_pixel, block_bytes, fourcc, r_mask, g_mask, b_mask, a_mask, content))"
_PF = f"""SELECT p_partkey AS tex, k.* FROM part JOIN (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES {_values([(r["luminance"], r["rgb"], r["alpha"], r["bits"], r["r_mask"], r["g_mask"], r["b_mask"], r["a_mask"], r["name"]) for r in legacy.mask_keys()])}) AS v(luminance, rgb, alpha, bits, r_mask, g_mask, b_mask, a_mask, expected)) k ON k.i = p_partkey % 23"""


@_query(f"""WITH pf AS ({_PF}), coded AS (SELECT tex, f.fourcc FROM (SELECT p_partkey AS tex, p_partkey % 40 AS j FROM part WHERE p_partkey % 23 >= {len(legacy.mask_keys())}) JOIN (SELECT *, row_number() OVER (ORDER BY fourcc) - 1 AS j FROM {_LEGACY_SQL} WHERE fourcc IS NOT NULL) f USING (j)),
told AS (SELECT tex, CASE WHEN tex % 10 = 0 THEN NULL ELSE expected END AS name FROM pf UNION ALL SELECT tex, f.name FROM coded JOIN {_LEGACY_SQL} f USING (fourcc))
SELECT p_partkey AS tex, name, f.bits_per_pixel::BIGINT AS bits_per_pixel, f.block_bytes::BIGINT AS block_bytes, f.content FROM part LEFT JOIN told ON told.tex = p_partkey LEFT JOIN {_LEGACY_SQL} f USING (name)""")
def legacy_classify(spark, sf_dir):
    """Pixel formats by masks (every tenth with a bit count that no format has) or by code (some unknown)."""
    keys = [(i, (0x20000 if r["luminance"] else 0) | (0x40 if r["rgb"] else 0) | (0x1 if r["alpha"] else 0), *(r[c] for c in ("bits", "r_mask", "g_mask", "b_mask", "a_mask"))) for i, r in enumerate(legacy.mask_keys())]
    dim = F.broadcast(spark.createDataFrame(keys, "i bigint, pf_flags bigint, rgb_bit_count bigint, r_mask bigint, g_mask bigint, b_mask bigint, a_mask bigint"))
    codes = sorted(r["fourcc"] for r in legacy.rows() if r["fourcc"] is not None)
    coded = F.broadcast(spark.createDataFrame(list(enumerate(codes)), "j bigint, fourcc bigint"))
    parts = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tex"), (F.col("p_partkey") % 23).alias("i"), F.when(F.col("p_partkey") % 23 >= len(keys), F.col("p_partkey") % 40).alias("j"))
    heads = parts.join(dim, "i", "left").join(coded, "j", "left").withColumn("pf_flags", F.coalesce("pf_flags", F.lit(4).cast("long")))
    heads = heads.withColumn("rgb_bit_count", F.when((F.col("tex") % 10 == 0) & F.col("j").isNull(), F.lit(77).cast("long")).otherwise(F.col("rgb_bit_count")))
    return containers.legacy_format(heads).select("tex", "name", "bits_per_pixel", "block_bytes", "content")
