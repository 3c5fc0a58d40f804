"""Queries over blocks of two halves, layouts, block rows and the maps between signed and unsigned values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import palette
from ..sources import textures
from . import pack, views
from .catalog import _W4, _W6, _query

_TWO = """SELECT DISTINCT l_partkey * 31 % 65536 AS c0, l_suppkey * 977 % 65536 AS c1, l_orderkey * 2654435761 % 4294967296 AS idx, CAST(l_quantity AS BIGINT) * 5 % 256 AS a0, CAST(round(l_discount * 100) AS BIGINT) * 23 % 256 AS a1,
  (l_orderkey * 40503 % 16777216) * 16777216 + l_partkey * 2654435761 % 16777216 AS aidx FROM lineitem"""
_EX = "(({r}) * 527 + 23) >> 6, (({g}) * 259 + 33) >> 6, (({b}) * 527 + 23) >> 6"


def _third(m: int, n: int) -> str:
    return f"((({m} * r0 + {n} * r1) * 351 + 61) >> 7), ((({m} * g0 + {n} * g1) * 2763 + 1039) >> 11), ((({m} * b0 + {n} * b1) * 351 + 61) >> 7)"


#: The four opaque colours of a block, as lists of red, green and blue.
_COLOURS = f"""t AS ({_TWO}), e AS (SELECT *, c0 >> 11 AS r0, (c0 >> 5) % 64 AS g0, c0 % 32 AS b0, c1 >> 11 AS r1, (c1 >> 5) % 64 AS g1, c1 % 32 AS b1 FROM t),
p AS (SELECT *, [[{_EX.format(r="r0", g="g0", b="b0")}], [{_EX.format(r="r1", g="g1", b="b1")}], [{_third(2, 1)}], [{_third(1, 2)}]] AS pal FROM e), k AS (SELECT UNNEST(range(16)) AS k),
q AS (SELECT p.*, k, pal[((idx >> (2 * k)) % 4) + 1] AS c FROM p, k)"""


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views._view(spark, sf_dir, "lineitem", _TWO.replace("DISTINCT ", "")).distinct()


def _colours(blocks: DataFrame) -> DataFrame:
    """A row for each pixel with its opaque colour; each block's palette is made once."""
    held = blocks.withColumn("pal", palette.bc1_palette("c0", "c1", opaque=True))
    px = held.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    return px.withColumn("e", F.get("pal", palette.index_at("idx", 2, F.col("k")).cast("int")))


@_query(f"WITH {_COLOURS} SELECT c0, c1, idx, aidx, k, c[1]::BIGINT AS r, c[2]::BIGINT AS g, c[3]::BIGINT AS b, CASE WHEN k < 12 THEN ((aidx >> (4 * k)) % 16) * 17 ELSE ((a0 >> (4 * (k % 2))) % 16) * 17 END::BIGINT AS a FROM q")
def bc2_decode(spark, sf_dir):
    """Explicit alpha, four bits a pixel (the last four from the ends' bits)."""
    px = _colours(_two(spark, sf_dir))
    nibble = F.when(F.col("k") < 12, palette.index_at("aidx", 4, F.least("k", F.lit(11).cast("long")))).otherwise(palette.index_at("a0", 4, F.col("k") % 2))
    return px.select("c0", "c1", "idx", "aidx", "k", "e.r", "e.g", "e.b", (nibble * 17).cast("long").alias("a"))


_SIX = ", ".join(f"({6 - k} * a0 + {k + 1} * a1 + 1) // 7" for k in range(6))
_FOUR = ", ".join(f"({4 - k} * a0 + {k + 1} * a1 + 1) // 5" for k in range(4))


@_query(f"WITH {_COLOURS} SELECT c0, c1, idx, a0, a1, aidx, k, c[1]::BIGINT AS r, c[2]::BIGINT AS g, c[3]::BIGINT AS b, (CASE WHEN a0 > a1 THEN [a0, a1, {_SIX}] ELSE [a0, a1, {_FOUR}, 0, 255] END)[((aidx >> (3 * k)) % 8) + 1]::BIGINT AS a FROM q")
def bc3_decode(spark, sf_dir):
    px = _colours(_two(spark, sf_dir).withColumn("ramp", palette.bc3_alpha_palette("a0", "a1")))
    return px.select("c0", "c1", "idx", "a0", "a1", "aidx", "k", "e.r", "e.g", "e.b", F.get("ramp", palette.index_at("aidx", 3, F.col("k")).cast("int")).alias("a"))


def _ramp(low: str, high: str) -> str:
    six, four = (w.replace("e0", low).replace("e1", high) for w in (_W6, _W4))
    return f"CASE WHEN {low} > {high} THEN [{low}, {high}, {six}] ELSE [{low}, {high}, {four}, 0, 255] END"


@_query(f"WITH t AS ({_TWO}), x AS (SELECT *, c0 % 256 AS g0, c1 % 256 AS g1, (aidx * 7 + idx) % 281474976710656 AS gidx FROM t), p AS (SELECT *, {_ramp('a0', 'a1')} AS reds, {_ramp('g0', 'g1')} AS greens FROM x) SELECT c0, c1, idx, a0, a1, aidx, k, reds[((aidx >> (3 * k)) % 8) + 1]::BIGINT AS r, greens[((gidx >> (3 * k)) % 8) + 1]::BIGINT AS g FROM p, (SELECT UNNEST(range(16)) AS k)")
def bc5_decode(spark, sf_dir):
    """Two single-channel halves."""
    b = _two(spark, sf_dir).withColumns({"g0": F.col("c0") % 256, "g1": F.col("c1") % 256, "gidx": (F.col("aidx") * 7 + F.col("idx")) % (1 << 48)})
    px = b.withColumns({"reds": palette.bc4_palette("a0", "a1"), "greens": palette.bc4_palette("g0", "g1")}).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    at = lambda ramp, word: F.get(ramp, palette.index_at(word, 3, F.col("k")).cast("int"))
    return px.select("c0", "c1", "idx", "a0", "a1", "aidx", "k", at("reds", "aidx").alias("r"), at("greens", "gidx").alias("g"))


@_query("SELECT v, s, ((s + 127) * 255 + 127) // 254 AS back FROM (SELECT v, LEAST(127, GREATEST(-127, (v * 253 + 127) // 254 - 127)) AS s FROM (SELECT UNNEST(range(256)) AS v))")
def snorm_maps(spark, sf_dir):
    """Unsigned values as signed ones, and back for scoring."""
    s = F.least(F.greatest(palette.div(F.col("v") * 253 + 127, 254) - 127, F.lit(-127)), F.lit(127)).cast("long")
    rows = spark.range(256).withColumnRenamed("id", "v").withColumn("s", s)
    return rows.withColumn("back", palette.div((F.col("s") + 127) * 255 + 127, 254))


_LAYOUT = "SELECT p_partkey AS tex, p_size % 9 AS width, p_partkey % 5 AS height, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 3 ELSE 1 END AS depth, p_partkey % 8 AS mips, CASE WHEN p_partkey % 3 = 0 THEN 6 ELSE p_partkey % 13 END AS layers, p_partkey % 2 = 0 AS is_cube FROM part"


@_query(f"SELECT tex, CASE WHEN width * height * depth * mips * layers = 0 THEN 'InvalidField' WHEN is_cube AND layers % 6 <> 0 THEN 'InvalidField' WHEN is_cube AND depth <> 1 THEN 'InvalidField' WHEN depth > 1 AND layers <> 1 THEN 'InvalidField' END AS error, width * height * depth * layers * 4 AS source_bytes FROM ({_LAYOUT})")
def layout_errors(spark, sf_dir):
    """What is wrong with images to encode, and the bytes that they must have."""
    t = views._view(spark, sf_dir, "part", _LAYOUT)
    t = t.select("tex", *[F.col(c).cast("long").alias(c) for c in ("width", "height", "depth", "mips", "layers")], "is_cube")
    return t.select("tex", textures.layout_error(*[F.col(c) for c in ("width", "height", "depth", "mips", "layers", "is_cube")]).alias("error"), (F.col("width") * F.col("height") * F.col("depth") * F.col("layers") * 4).alias("source_bytes"))


@_query("""WITH s AS (SELECT p_partkey AS tex, CASE p_partkey % 4 WHEN 0 THEN 'rgba8' WHEN 1 THEN 'bc1' WHEN 2 THEN 'bc7' ELSE 'bgra8' END AS "class", p_size * 3 + 1 AS height FROM part),
r AS (SELECT *, CASE WHEN "class" IN ('rgba8', 'bgra8') THEN height ELSE (height + 3) // 4 END AS n FROM s) SELECT tex, n::BIGINT AS block_rows, f::BIGINT AS first_row, LEAST(f + 16, n)::BIGINT AS end_row FROM (SELECT *, UNNEST(range(0, n, 16)) AS f FROM r)""")
def block_row_parts(spark, sf_dir):
    """Independent parts of sixteen block rows of each surface."""
    kind = F.element_at(F.array(*[F.lit(x) for x in ("rgba8", "bc1", "bc7", "bgra8")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    s = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tex"), kind.alias("class"), (F.col("p_size") * 3 + 1).cast("long").alias("height"))
    return textures.block_row_ranges(s, 16).select("tex", "block_rows", "first_row", "end_row")


@_query("""WITH l AS (SELECT p_partkey AS tex, CASE p_partkey % 5 WHEN 0 THEN 'tier high' WHEN 1 THEN 'note ' || p_partkey WHEN 2 THEN 'texture t' || p_partkey || '.dds bc1 64 64 7 ' || p_size || ' 00ff' WHEN 3 THEN 'texture  t.dds  bc9 1 1 1 1 a' ELSE 'texture t.dds bc7 1 x' END AS line FROM part),
w AS (SELECT tex, string_split_regex(trim(line), '\\s+') AS w FROM l)
SELECT tex, w[2] AS file, w[3] AS content, TRY_CAST(w[4] AS BIGINT) AS width, TRY_CAST(w[7] AS BIGINT) AS bytes, w[8] AS hash, CASE WHEN w[3] = 'bc1' THEN NULL ELSE 'InvalidField' END AS error FROM w WHERE w[1] = 'texture'""")
def pack_textures(spark, sf_dir):
    """A pack's manifest read line by line: textures, other fields, unknown and damaged lines."""
    p = views.table(spark, sf_dir, "part")
    n, size, k = F.col("p_partkey").cast("string"), F.col("p_size").cast("string"), F.col("p_partkey") % 5
    line = F.when(k == 0, "tier high").when(k == 1, F.concat(F.lit("note "), n)).when(k == 2, F.concat(F.lit("texture t"), n, F.lit(".dds bc1 64 64 7 "), size, F.lit(" 00ff"))).when(k == 3, "texture  t.dds  bc9 1 1 1 1 a").otherwise("texture t.dds bc7 1 x")
    return pack.parse_manifest(p.select(F.col("p_partkey").alias("tex"), line.alias("value")))[1].select("tex", "file", "content", "width", "bytes", "hash", "error")
