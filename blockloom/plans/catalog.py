"""The queries over the texture operators, each with the same computation as SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formats, palette
from ..operators import pixels, surfaces
from ..session import ship
from ..sources import dds
from ..streaming import pool
from . import board, residency, runs, views

FLAGSHIP = "mip_box_filter"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _content(spark: SparkSession) -> DataFrame:
    rows = [(i, name, size) for i, (name, size) in enumerate(formats.CONTENT)]
    return spark.createDataFrame(rows, "content_id bigint, content string, block_bytes bigint")


def _dxgi(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([tuple(r.values()) for r in formats.dxgi_rows()], formats.DXGI_DDL)


def _values(rows: list[tuple]) -> str:
    show = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(map(show, r)) + ")" for r in rows)


_CONTENT_SQL = f"(SELECT * FROM (VALUES {_values([(i, n, b) for i, (n, b) in enumerate(formats.CONTENT)])}) AS c(content_id, content, block_bytes))"
_PAYLOAD_SQL = "COALESCE(((width + 3) // 4) * ((height + 3) // 4) * block_bytes, width * height * 4)"
_CHAIN_SQL = f"""t AS (SELECT tex, width, height, mips, content, block_bytes, COALESCE(block_bytes, 4) AS least, {_PAYLOAD_SQL} AS size0
  FROM ({views.TEX_PART}) JOIN {_CONTENT_SQL} USING (content_id)),
lv AS (SELECT *, GREATEST(size0 >> (2 * mip), least) AS length, GREATEST(1, width >> mip) AS mip_width, GREATEST(1, height >> mip) AS mip_height
  FROM (SELECT *, UNNEST(range(mips)) AS mip FROM t)),
ch AS (SELECT *, COALESCE(SUM(length) OVER (PARTITION BY tex ORDER BY mip ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM lv)"""


def _levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    tex = views.tex_part(spark, sf_dir).join(F.broadcast(_content(spark)), "content_id")
    sized = tex.withColumns({"least": F.coalesce("block_bytes", F.lit(4).cast("long")), "size0": palette.payload_bytes("width", "height", "block_bytes")})
    return surfaces.mip_chain(sized)


@_query(f"WITH {_CHAIN_SQL} SELECT tex, mip, mip_width, mip_height, \"offset\", length FROM ch")
def mip_dims_offsets(spark, sf_dir):
    return _levels(spark, sf_dir).select("tex", "mip", "mip_width", "mip_height", "offset", "length")


@_query(f"WITH {_CHAIN_SQL} SELECT content, COUNT(*) AS n, SUM({_PAYLOAD_SQL})::BIGINT AS bytes FROM t GROUP BY content")
def payload_bytes_by_format(spark, sf_dir):
    tex = views.tex_part(spark, sf_dir).join(F.broadcast(_content(spark)), "content_id")
    return tex.groupBy("content").agg(F.count("*").alias("n"), F.sum(palette.payload_bytes("width", "height", "block_bytes")).alias("bytes"))


@_query(f"""WITH {_CHAIN_SQL} SELECT tex, mip, "offset", length, COALESCE((mip_width + 3) // 4 * block_bytes, mip_width * 4) AS bytes_per_row,
  CASE WHEN block_bytes IS NULL THEN mip_height ELSE (mip_height + 3) // 4 END AS rows_per_image, mip_width * mip_height * 4 AS decoded_bytes,
  COALESCE(((mip_width + 3) // 4) * ((mip_height + 3) // 4) * block_bytes, mip_width * mip_height * 4) > length AS truncated FROM ch""")
def upload_plan(spark, sf_dir):
    return surfaces.upload_plan(_levels(spark, sf_dir)).select("tex", "mip", "offset", "length", "bytes_per_row", "rows_per_image", "decoded_bytes", (F.col("needed") > F.col("length")).alias("truncated"))


@_query(f"WITH {_CHAIN_SQL} SELECT tex, LEAST(SUM(length), 4294967295)::BIGINT AS stride FROM ch GROUP BY tex")
def array_stride(spark, sf_dir):
    tex = views.tex_part(spark, sf_dir).join(F.broadcast(_content(spark)), "content_id")
    return tex.withColumns({"least": F.coalesce("block_bytes", F.lit(4).cast("long")), "size0": palette.payload_bytes("width", "height", "block_bytes")}).select("tex", surfaces.array_stride().alias("stride"))


@_query(f"""WITH {_CHAIN_SQL}, st AS (SELECT tex, LEAST(SUM(length), 4294967295)::BIGINT AS stride FROM ch GROUP BY tex),
x AS (SELECT ch.*, st.stride, 1 + tex % 3 AS layers, CASE WHEN tex % 4 = 0 THEN 6 ELSE 1 END AS faces FROM ch JOIN st USING (tex)), y AS (SELECT *, UNNEST(range(layers * faces)) AS s FROM x)
SELECT tex, s // faces AS layer, s % faces AS face, mip, s * stride + "offset" AS "offset", length, CASE WHEN s * stride + "offset" + length > stride * layers * faces - tex % 5 * 16 THEN 'TruncatedData' END AS error FROM y""")
def subresource_ranges(spark, sf_dir):
    tex = views.tex_part(spark, sf_dir).join(F.broadcast(_content(spark)), "content_id")
    sized = tex.withColumns({"least": F.coalesce("block_bytes", F.lit(4).cast("long")), "size0": palette.payload_bytes("width", "height", "block_bytes"), "layers": 1 + F.col("tex") % 3, "faces": F.when(F.col("tex") % 4 == 0, F.lit(6).cast("long")).otherwise(F.lit(1).cast("long"))})
    held = sized.withColumn("payload_bytes", surfaces.array_stride() * F.col("layers") * F.col("faces") - F.col("tex") % 5 * 16)
    return surfaces.subresources(held).select("tex", "layer", "face", "mip", "offset", "length", "error")


_DXGI_SQL = "(SELECT * FROM (VALUES " + _values([tuple(r.values()) for r in formats.dxgi_rows()]) + ") AS d(code, name, bits_per_pixel, block_bytes, content, hdr_content, gpu_name, wgpu_name, vulkan_name))"
_FOURCC_SQL = "(SELECT * FROM (VALUES " + _values(list(formats.FOURCC.items())) + ") AS f(fourcc, legacy))"
_FILES_SQL = "(SELECT p_partkey AS tex, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 140 END AS dxgi, CASE p_partkey % 7 WHEN 0 THEN 'DXT1' WHEN 1 THEN 'DXT3' WHEN 2 THEN 'DXT5' WHEN 3 THEN 'ATI1' WHEN 4 THEN 'ATI2' WHEN 5 THEN 'BC4U' ELSE NULL END AS fourcc FROM part)"


@_query(f"""SELECT tex, d.name AS format, d.content, d.gpu_name, d.wgpu_name, d.vulkan_name, COALESCE(d.bits_per_pixel, 0)::BIGINT AS bits_per_pixel,
  CASE WHEN d.name IS NULL THEN 'InvalidField' WHEN d.content IS NULL AND d.hdr_content IS NULL THEN 'UnsupportedFormat' END AS error
FROM {_FILES_SQL} LEFT JOIN {_FOURCC_SQL} USING (fourcc) LEFT JOIN {_DXGI_SQL} d ON CASE WHEN dxgi IS NOT NULL THEN d.code = dxgi ELSE d.name = legacy END""")
def format_classify(spark, sf_dir):
    """A DX10 header's code wins; without one the four characters decide."""
    four = F.col("p_partkey") % 7
    code = F.when(four == 0, "DXT1").when(four == 1, "DXT3").when(four == 2, "DXT5").when(four == 3, "ATI1").when(four == 4, "ATI2").when(four == 5, "BC4U")
    files = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tex"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey") % 140).alias("dxgi"), code.alias("fourcc"))
    dim = _dxgi(spark)
    legacy = spark.createDataFrame(list(formats.FOURCC.items()), "fourcc string, name string").join(dim.select("name", F.col("code").alias("legacy")), "name").select("fourcc", "legacy")
    known = files.join(F.broadcast(legacy), "fourcc", "left").withColumn("code", F.coalesce("dxgi", "legacy")).join(F.broadcast(dim), "code", "left")
    error = F.when(F.col("name").isNull(), "InvalidField").when(F.col("content").isNull() & F.col("hdr_content").isNull(), "UnsupportedFormat")
    return known.select("tex", F.col("name").alias("format"), "content", "gpu_name", "wgpu_name", "vulkan_name", F.coalesce("bits_per_pixel", F.lit(0).cast("long")).alias("bits_per_pixel"), error.alias("error"))


_GATHER_SQL = f"""px AS ({views.PX_EVENTS}), h AS (SELECT MAX(y) + 1 AS height FROM px),
g AS (SELECT by_ AS "by", bx, k, r, g, b, a FROM (SELECT by_, bx, k, LEAST(by_ * 4 + k // 4, height - 1) AS y, LEAST(bx * 4 + k % 4, {views.WIDTH - 1}) AS x
  FROM (SELECT UNNEST(range((height + 3) // 4)) AS by_, height FROM h), (SELECT UNNEST(range({(views.WIDTH + 3) // 4})) AS bx), (SELECT UNNEST(range(16)) AS k)) JOIN px USING (x, y))"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = views.px_events(spark, sf_dir)
    height = px.agg(F.max("y")).first()[0]
    return pixels.gather_blocks(px, views.WIDTH, (height if height is not None else -1) + 1)


@_query(f"WITH {_GATHER_SQL} SELECT * FROM g")
def block_gather_edge_clamp(spark, sf_dir):
    return _blocks(spark, sf_dir)


@_query(f"""WITH {_GATHER_SQL} SELECT "by", bx, MIN(r) AS r_min, MAX(r) AS r_max, MIN(g) AS g_min, MAX(g) AS g_max, MIN(b) AS b_min, MAX(b) AS b_max, MIN(a) AS a_min, MAX(a) AS a_max FROM g GROUP BY "by", bx""")
def channel_minmax(spark, sf_dir):
    return pixels.block_minmax(_blocks(spark, sf_dir))


@_query(f"""WITH px AS ({views.PX_EVENTS}) SELECT MAX(r) - MIN(r) AS r_span, MAX(g) - MIN(g) AS g_span, MAX(b) - MIN(b) AS b_span, MAX(a) - MIN(a) AS a_span, MAX(r) - MIN(r) <= 2 AS flat FROM px""")
def channel_span_flat_gate(spark, sf_dir):
    spans = views.px_events(spark, sf_dir).agg(*[(F.max(c) - F.min(c)).alias(f"{c}_span") for c in pixels.CHANNELS])
    return spans.withColumn("flat", F.col("r_span") <= 2)


@_query(f"""WITH {_GATHER_SQL}, l AS (SELECT *, 2 * r + 3 * g + b AS o FROM g)
SELECT "by", bx, MIN(o) AS dark, arg_min(k, o * 16 + k) AS dark_k, MAX(o) AS bright, arg_min(k, -o * 16 + k) AS bright_k FROM l GROUP BY "by", bx""")
def luminance_extrema(spark, sf_dir):
    return pixels.luminance_extrema(_blocks(spark, sf_dir))


def _mip_sql(levels: int) -> str:
    ctes = [f"m0 AS ({views.PX_EVENTS}), d0 AS (SELECT {views.WIDTH} AS w, MAX(y) + 1 AS h FROM m0)"]
    for k in range(1, levels + 1):
        ctes.append(f"d{k} AS (SELECT GREATEST(1, w // 2) AS w, GREATEST(1, h // 2) AS h FROM d{k - 1})")
        means = ", ".join(f"((SUM({c}) + COUNT(*) // 2) // COUNT(*))::BIGINT AS {c}" for c in pixels.CHANNELS)
        ctes.append(f"m{k} AS (SELECT x // 2 AS x, y // 2 AS y, {means} FROM m{k - 1} WHERE x // 2 < (SELECT w FROM d{k}) AND y // 2 < (SELECT h FROM d{k}) GROUP BY x // 2, y // 2)")
    return f"WITH {', '.join(ctes)} SELECT {levels} AS mip, x, y, r, g, b, a FROM m{levels}"


@_query(_mip_sql(3).replace("3 AS mip", "CAST(3 AS BIGINT) AS mip"))
def mip_box_filter(spark, sf_dir):
    px = views.px_events(spark, sf_dir)
    width, height = views.WIDTH, (px.agg(F.max("y")).first()[0] or 0) + 1
    for _ in range(3):
        px = pixels.halve(px, width, height)
        width, height = max(1, width // 2), max(1, height // 2)
    return px.select(F.lit(3).cast("long").alias("mip"), "x", "y", *pixels.CHANNELS)


@_query(f"""SELECT x, y, r >> 3 << 11 | g >> 2 << 5 | b >> 3 AS c565, (r >> 3) * 8 + (r >> 5) AS r8, (g >> 2) * 4 + (g >> 6) AS g8, (b >> 3) * 8 + (b >> 5) AS b8 FROM ({views.PX_EVENTS})""".replace("r >> 3 << 11 | g >> 2 << 5 | b >> 3", "(r >> 3) * 2048 + (g >> 2) * 32 + (b >> 3)"))
def rgb565_roundtrip(spark, sf_dir):
    px = views.px_events(spark, sf_dir).withColumn("c565", palette.quantise565("r", "g", "b"))
    r, g, b = palette.replicate565("c565")
    return px.select("x", "y", "c565", r.alias("r8"), g.alias("g8"), b.alias("b8"))


_ENDS = ", ".join(f"(c{i} >> 11) % 32 AS r{i}, (c{i} >> 5) % 64 AS g{i}, c{i} % 32 AS b{i}" for i in (0, 1))
_PALETTE_SQL = f"""blk AS (SELECT DISTINCT c0, c1, idx FROM ({views.BLK_LINEITEM})), e AS (SELECT *, {_ENDS} FROM blk),
pal AS (SELECT c0, c1, idx, 0 AS i, (r0 * 527 + 23) >> 6 AS r, (g0 * 259 + 33) >> 6 AS g, (b0 * 527 + 23) >> 6 AS b, 255 AS a FROM e
UNION ALL SELECT c0, c1, idx, 1, (r1 * 527 + 23) >> 6, (g1 * 259 + 33) >> 6, (b1 * 527 + 23) >> 6, 255 FROM e
UNION ALL SELECT c0, c1, idx, 2, CASE WHEN c0 > c1 THEN ((2 * r0 + r1) * 351 + 61) >> 7 ELSE ((r0 + r1) * 1053 + 125) >> 8 END,
  CASE WHEN c0 > c1 THEN ((2 * g0 + g1) * 2763 + 1039) >> 11 ELSE ((g0 + g1) * 4145 + 1019) >> 11 END, CASE WHEN c0 > c1 THEN ((2 * b0 + b1) * 351 + 61) >> 7 ELSE ((b0 + b1) * 1053 + 125) >> 8 END, 255 FROM e
UNION ALL SELECT c0, c1, idx, 3, CASE WHEN c0 > c1 THEN ((r0 + 2 * r1) * 351 + 61) >> 7 ELSE 0 END, CASE WHEN c0 > c1 THEN ((g0 + 2 * g1) * 2763 + 1039) >> 11 ELSE 0 END,
  CASE WHEN c0 > c1 THEN ((b0 + 2 * b1) * 351 + 61) >> 7 ELSE 0 END, CASE WHEN c0 > c1 THEN 255 ELSE 0 END FROM e)"""


@_query(f"WITH {_PALETTE_SQL} SELECT c0, c1, i::BIGINT AS i, r, g, b, a::BIGINT AS a, COUNT(*) AS n FROM pal GROUP BY ALL")
def bc1_palette(spark, sf_dir):
    blocks = views.blk_lineitem(spark, sf_dir).distinct().groupBy("c0", "c1").agg(F.count("*").alias("n"))
    return blocks.select("c0", "c1", "n", F.posexplode(palette.bc1_palette("c0", "c1")).alias("i", "e")).select("c0", "c1", F.col("i").cast("long").alias("i"), "e.*", "n")


@_query(f"""WITH {_PALETTE_SQL}, k AS (SELECT UNNEST(range(16)) AS k)
SELECT pal.c0, pal.c1, pal.idx, k, r, g, b, a::BIGINT AS a FROM blk CROSS JOIN k JOIN pal ON pal.c0 = blk.c0 AND pal.c1 = blk.c1 AND pal.idx = blk.idx AND pal.i = (blk.idx >> (2 * k)) % 4""")
def bc1_decode(spark, sf_dir):
    return pixels.decode_bc1(views.blk_lineitem(spark, sf_dir))


_W6 = ", ".join(f"e0 + ((({w}) * (e1 - e0) + 32768) >> 16)" for w in palette.W6)
_W4 = ", ".join(f"e0 + ((({w}) * (e1 - e0) + 32768) >> 16)" for w in palette.W4)
_BC4_SQL = f"""blk AS (SELECT DISTINCT a0, a1, idx FROM ({views.BLK_ALPHA})), ends AS (SELECT DISTINCT a0, a1, a0 AS e0, a1 AS e1 FROM blk),
pal AS (SELECT a0, a1, CASE WHEN e0 > e1 THEN [e0, e1, {_W6}] ELSE [e0, e1, {_W4}, 0, 255] END AS p FROM ends)"""


def _ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.blk_alpha(spark, sf_dir).select("a0", "a1").distinct()


@_query(f"WITH {_BC4_SQL} SELECT a0, a1, i, p[i + 1] AS v FROM pal, (SELECT UNNEST(range(8)) AS i)")
def bc4_palette(spark, sf_dir):
    return _ends(spark, sf_dir).select("a0", "a1", F.posexplode(palette.bc4_palette("a0", "a1")).alias("i", "v")).withColumn("i", F.col("i").cast("long"))


@_query(f"""WITH ends AS (SELECT DISTINCT a0, a1 FROM ({views.BLK_ALPHA})), s AS (SELECT a0, a1, GREATEST(CASE WHEN a0 > 127 THEN a0 - 256 ELSE a0 END, -127) AS e0, GREATEST(CASE WHEN a1 > 127 THEN a1 - 256 ELSE a1 END, -127) AS e1 FROM ends),
pal AS (SELECT a0, a1, CASE WHEN e0 > e1 THEN [e0, e1, {_W6}] ELSE [e0, e1, {_W4}, -127, 127] END AS p FROM s) SELECT a0, a1, i, p[i + 1]::BIGINT AS v FROM pal, (SELECT UNNEST(range(8)) AS i)""")
def bc4_palette_signed(spark, sf_dir):
    return _ends(spark, sf_dir).select("a0", "a1", F.posexplode(palette.bc4_palette("a0", "a1", signed=True)).alias("i", "v")).select("a0", "a1", F.col("i").cast("long").alias("i"), F.col("v").cast("long").alias("v"))


@_query(f"WITH {_BC4_SQL}, k AS (SELECT UNNEST(range(16)) AS k) SELECT a0, a1, idx, k, p[((idx >> (3 * k)) % 8) + 1] AS v FROM blk JOIN pal USING (a0, a1) CROSS JOIN k")
def bc4_decode(spark, sf_dir):
    blocks = views.blk_alpha(spark, sf_dir).distinct()
    return blocks.select("a0", "a1", "idx", F.posexplode(palette.decode_indexed(palette.bc4_palette("a0", "a1"), "idx", 3)).alias("k", "v")).withColumn("k", F.col("k").cast("long"))


_SIX = ", ".join(f"({6 - k} * a0 + {k + 1} * a1 + 1) // 7" for k in range(6))
_FOUR = ", ".join(f"({4 - k} * a0 + {k + 1} * a1 + 1) // 5" for k in range(4))


@_query(f"""WITH pal AS (SELECT a0, a1, CASE WHEN a0 > a1 THEN [a0, a1, {_SIX}] ELSE [a0, a1, {_FOUR}, 0, 255] END AS p FROM (SELECT DISTINCT a0, a1 FROM ({views.BLK_ALPHA})))
SELECT a0, a1, i, p[i + 1] AS v FROM pal, (SELECT UNNEST(range(8)) AS i)""")
def bc3_alpha_palette(spark, sf_dir):
    return _ends(spark, sf_dir).select("a0", "a1", F.posexplode(palette.bc3_alpha_palette("a0", "a1")).alias("i", "v")).withColumn("i", F.col("i").cast("long"))


_FIT_SQL = f"""WITH f AS (SELECT DISTINCT c0, c1, idx % 256 AS r, idx // 256 % 256 AS g, idx // 65536 % 256 AS b FROM ({views.BLK_LINEITEM})),
e AS (SELECT *, {_ENDS} FROM f), x AS (SELECT *, r0 * 8 + (r0 >> 2) AS p0, g0 * 4 + (g0 >> 4) AS p1, b0 * 8 + (b0 >> 2) AS p2, r1 * 8 + (r1 >> 2) AS q0, g1 * 4 + (g1 >> 4) AS q1, b1 * 8 + (b1 >> 2) AS q2 FROM e),
d AS (SELECT c0, c1, r, g, b, [(p0 - r) * (p0 - r) + (p1 - g) * (p1 - g) + (p2 - b) * (p2 - b), (q0 - r) * (q0 - r) + (q1 - g) * (q1 - g) + (q2 - b) * (q2 - b),
  ((2 * p0 + q0) // 3 - r) ** 2 + ((2 * p1 + q1) // 3 - g) ** 2 + ((2 * p2 + q2) // 3 - b) ** 2, ((p0 + 2 * q0) // 3 - r) ** 2 + ((p1 + 2 * q1) // 3 - g) ** 2 + ((p2 + 2 * q2) // 3 - b) ** 2]::BIGINT[] AS ds FROM x)
SELECT c0, c1, r, g, b, list_min(ds) AS d, (list_position(ds, list_min(ds)) - 1)::BIGINT AS i FROM d"""


@_query(_FIT_SQL)
def bc1_index_fit(spark, sf_dir):
    """The nearest of an encoder's four colours for one pixel of each block."""
    v = views.blk_lineitem(spark, sf_dir)
    px = v.select("c0", "c1", (F.col("idx") % 256).alias("r"), (palette.div(F.col("idx"), 256) % 256).alias("g"), (palette.div(F.col("idx"), 65536) % 256).alias("b")).distinct()
    best = pixels.nearest_entry(pixels.encoder_palette("c0", "c1"), (F.col("r"), F.col("g"), F.col("b")))
    return px.withColumn("best", best).select("c0", "c1", "r", "g", "b", "best.d", "best.i")


@_query(f"WITH {_BC4_SQL}, x AS (SELECT DISTINCT a0, a1, idx % 256 AS v FROM blk), d AS (SELECT a0, a1, v, list_transform(p, lambda q: (q - v) * (q - v)) AS ds FROM x JOIN pal USING (a0, a1)) SELECT a0, a1, v, list_min(ds) AS d, (list_position(ds, list_min(ds)) - 1)::BIGINT AS i FROM d")
def alpha_index_fit(spark, sf_dir):
    px = views.blk_alpha(spark, sf_dir).select("a0", "a1", (F.col("idx") % 256).alias("v")).distinct()
    squares = F.transform(palette.bc4_palette("a0", "a1"), lambda q: (q - F.col("v")) * (q - F.col("v")))
    return px.withColumn("ds", squares).select("a0", "a1", "v", F.array_min("ds").alias("d"), (F.array_position("ds", F.array_min("ds")) - 1).alias("i"))


_BACK = "(r - (r >> 3) * 8 - (r >> 5)) ** 2 + (g - (g >> 2) * 4 - (g >> 6)) ** 2 + (b - (b >> 3) * 8 - (b >> 5)) ** 2"


@_query(f"SELECT y // 10 AS surface, COUNT(*) * 3 AS n, SUM(({_BACK})::BIGINT)::BIGINT AS squared, CASE WHEN SUM(({_BACK})::BIGINT) = 0 THEN NULL ELSE round(10 * log10(65025.0 / (SUM(({_BACK})::BIGINT) / (COUNT(*) * 3.0))), 6) END AS psnr FROM ({views.PX_EVENTS}) GROUP BY y // 10")
def psnr_by_surface(spark, sf_dir):
    """Quality of the 565 round trip, by bands of ten rows (null where nothing is lost)."""
    back = palette.replicate565(palette.quantise565("r", "g", "b"))
    error = pixels.squared_error((F.col("r"), F.col("g"), F.col("b")), back)
    sums = views.px_events(spark, sf_dir).groupBy(palette.div(F.col("y"), 10).alias("surface")).agg((F.count("*") * 3).alias("n"), F.sum(error).alias("squared"))
    return sums.withColumn("psnr", F.when(F.col("squared") > 0, F.round(pixels.psnr(F.col("squared"), F.col("n")), 6)))


@_query(f"SELECT MAX(GREATEST(abs(r - (r >> 3) * 8 - (r >> 5)), abs(g - (g >> 2) * 4 - (g >> 6)), abs(b - (b >> 3) * 8 - (b >> 5))))::BIGINT AS max_abs FROM ({views.PX_EVENTS})")
def max_abs_diff(spark, sf_dir):
    back = palette.replicate565(palette.quantise565("r", "g", "b"))
    return views.px_events(spark, sf_dir).agg(F.max(F.greatest(*[F.abs(F.col(c) - x) for c, x in zip("rgb", back, strict=True)])).alias("max_abs"))


@_query(f"SELECT word, n, rank FROM (SELECT idx % 65536 AS word, COUNT(*) AS n, row_number() OVER (ORDER BY COUNT(*) DESC, idx % 65536) AS rank FROM ({views.BLK_LINEITEM}) WHERE c0 > c1 GROUP BY 1) WHERE rank <= 24 AND n >= 2")
def table_dictionary_top24(spark, sf_dir):
    return pixels.top_words(views.blk_lineitem(spark, sf_dir).where("c0 > c1").select((F.col("idx") % 65536).alias("word"))).select("word", "n", "rank")


_FRAMES = 120
_REQUESTS_SQL = f"""cam AS (SELECT f AS frame, f * 5 - 300 AS cam_x, (f * 37) % 200 - 100 AS cam_z FROM (SELECT UNNEST(range({_FRAMES})) AS f)), w AS ({views.WORLD_PART}),
s AS (SELECT frame, tex, mips, (x - cam_x) * (x - cam_x) + (z - cam_z) * (z - cam_z) AS d2 FROM w, cam), q AS (SELECT frame, tex, mips, LEAST(CAST(round(GREATEST(log2(GREATEST(sqrt(d2) / {residency.NEAR}, 1.0)), 0.0)) AS BIGINT), mips - 1) AS top FROM s WHERE d2 <= {residency.CULL**2}),
rq AS (SELECT frame, tex, UNNEST(range(top, mips)) AS mip FROM q)"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    cameras = spark.range(_FRAMES).select(F.col("id").alias("frame"), (F.col("id") * 5 - 300).alias("cam_x"), (F.col("id") * 37 % 200 - 100).alias("cam_z"))
    return residency.requests(views.world_part(spark, sf_dir), cameras)


@_query(f"WITH {_REQUESTS_SQL} SELECT frame, tex, mip FROM rq")
def requests_range_join(spark, sf_dir):
    return _requests(spark, sf_dir)


_LEVEL_SQL = "COALESCE(((GREATEST(512 >> mip::INT, 1) + 3) // 4) * ((GREATEST(512 >> mip::INT, 1) + 3) // 4) * block_bytes, GREATEST(512 >> mip::INT, 1) * GREATEST(512 >> mip::INT, 1) * 4)"


@_query(f"WITH {_REQUESTS_SQL}, y AS (SELECT frame, SUM({_LEVEL_SQL}) AS bytes FROM rq JOIN {_CONTENT_SQL} c ON c.content_id = rq.tex % 10 GROUP BY frame) SELECT MAX(bytes)::BIGINT AS peak_bytes FROM y")
def peak_demand(spark, sf_dir):
    wanted = _requests(spark, sf_dir).withColumn("content_id", F.col("tex") % 10).join(F.broadcast(_content(spark)), "content_id")
    return residency.peak_demand(wanted.withColumn("bytes", residency.level_bytes(F.lit(512).cast("long"), F.col("mip"), F.col("block_bytes"))))


_FRAMES_SQL = "(SELECT event_id AS frame, user_id % 2 AS arm, value AS ms, event_type FROM events)"


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "events").select(F.col("event_id").alias("frame"), (F.col("user_id") % 2).alias("arm"), F.col("value").alias("ms"), "event_type", "user_id")


@_query(f"SELECT arm, COUNT(*) AS n, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, quantile_disc(ms, 0.99) AS p99, MAX(ms) AS worst, COUNT(*) FILTER (WHERE ms > 1.0) AS hitches FROM {_FRAMES_SQL} GROUP BY arm")
def frame_percentiles_nearest_rank(spark, sf_dir):
    frames = _frames(spark, sf_dir)
    ranks = runs.percentiles(frames, ["arm"], "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return frames.groupBy("arm").agg(F.count("*").alias("n"), F.max("ms").alias("worst"), F.count_if(F.col("ms") > 1.0).alias("hitches")).join(ranks, "arm")


@_query("""WITH r AS (SELECT user_id % 2 AS arm, user_id % 10 // 2 AS rep, quantile_disc(value, 0.5) AS med FROM events GROUP BY 1, 2), s AS (SELECT arm, quantile_disc(med, 0.5) AS med, CASE WHEN MIN(med) > 0 THEN MAX(med) / MIN(med) - 1 END AS spread FROM r GROUP BY arm)
SELECT round(b.med / a.med - 1, 9) AS delta, round(GREATEST(a.spread, b.spread), 9) AS band, CASE WHEN abs(b.med / a.med - 1) <= GREATEST(a.spread, b.spread) THEN 'inside the band' WHEN b.med > a.med THEN 'slower' ELSE 'faster' END AS verdict FROM s a, s b WHERE a.arm = 0 AND b.arm = 1""")
def arm_spread_verdict(spark, sf_dir):
    """Median of medians of each arm's runs, their difference, and the runs' own spread."""
    reps = _frames(spark, sf_dir).groupBy("arm", palette.div(F.col("user_id") % 10, 2).alias("rep")).agg(board.nearest_rank("ms", 0.5).alias("med"))
    arms = reps.groupBy("arm").agg(board.nearest_rank("med", 0.5).alias("med"), board.spread("med").alias("spread"))
    of = lambda k, c: F.max(F.when(F.col("arm") == k, F.col(c)))
    both = arms.agg(of(0, "med").alias("m0"), of(1, "med").alias("m1"), F.max("spread").alias("band"))
    delta = F.col("m1") / F.col("m0") - 1
    return both.select(F.round(delta, 9).alias("delta"), F.round("band", 9).alias("band"), board.verdict(delta, F.col("band")).alias("verdict"))


@_query("SELECT key, n_values FROM (SELECT 'lang' AS key, COUNT(DISTINCT lang) AS n_values FROM documents UNION ALL SELECT 'source', COUNT(DISTINCT source) FROM documents UNION ALL SELECT 'positive', COUNT(DISTINCT (n_chars >= 0)::VARCHAR) FROM documents) WHERE n_values > 1")
def gate_distinct(spark, sf_dir):
    docs = views.table(spark, sf_dir, "documents").select("lang", "source", (F.col("n_chars") >= 0).alias("positive"))
    return board.disagreeing(docs, ["lang", "source", "positive"])


@_query("""WITH p AS (SELECT event_id // 2 AS pair, MAX(CASE WHEN event_id % 2 = 0 THEN value END) AS a, MAX(CASE WHEN event_id % 2 = 1 THEN value END) AS b FROM events GROUP BY 1),
c AS (SELECT COUNT(*) FILTER (WHERE a < b) AS wins, COUNT(*) FILTER (WHERE a > b) AS losses, COUNT(*) FILTER (WHERE a = b) AS ties FROM p)
SELECT wins, losses, ties, round((wins - (wins + losses) / 2.0) / sqrt((wins + losses) / 4.0), 9) AS z FROM c""")
def sign_test_z(spark, sf_dir):
    e = views.table(spark, sf_dir, "events")
    side = lambda k: F.max(F.when(F.col("event_id") % 2 == k, F.col("value")))
    pairs = e.groupBy(palette.div(F.col("event_id"), 2).alias("pair")).agg(side(0).alias("a"), side(1).alias("b"))
    counts = pairs.agg(F.count_if(F.col("a") < F.col("b")).alias("wins"), F.count_if(F.col("a") > F.col("b")).alias("losses"), F.count_if(F.col("a") == F.col("b")).alias("ties"))
    return counts.withColumn("z", F.round(board.sign_z(F.col("wins"), F.col("losses")), 9))


_BUCKET_SQL = f"CASE WHEN ms <= {board.LOW_MS} OR isnan(ms) THEN 0 ELSE LEAST(floor(ln(ms / {board.LOW_MS}) / {math.log(board.HIGH_MS / board.LOW_MS)!r} * {board.BUCKETS}), {board.BUCKETS - 1})::BIGINT END"


@_query(f"SELECT arm, {_BUCKET_SQL} AS bucket, COUNT(*) AS n FROM {_FRAMES_SQL} GROUP BY 1, 2")
def log_histogram(spark, sf_dir):
    return board.histogram(_frames(spark, sf_dir), "arm", "ms")


@_query(f"""SELECT tex, height, width, CASE WHEN tex % 2 = 0 THEN mips END AS mip_map_count, CASE WHEN tex % 3 = 0 THEN 71 + tex % 9 END AS dxgi, tex % 5 = 0 AND tex % 3 = 0 OR tex % 3 <> 0 AND tex % 4 = 0 AS is_cube,
  CASE WHEN tex % 3 = 0 THEN 148 ELSE 128 END AS payload_offset, octet_length(encode('p' || tex))::BIGINT AS payload_bytes FROM ({views.TEX_PART})""")
def header_parse_words(spark, sf_dir):
    """Headers written to bytes and parsed back, half of them with a level count, a third with the second header."""
    tex = F.col("tex")
    payload = F.concat(F.lit("p"), tex.cast("string")).cast("binary")
    common = {"flags": F.when(tex % 2 == 0, dds.F_MIPS).otherwise(0), "height": F.col("height"), "width": F.col("width"), "mips": F.col("mips"), "pf_flags": dds.P_FOURCC}
    wide = dds.compose(common | {"pf_fourcc": dds.DX10}, {"dxgi": 71 + tex % 9, "dimension": 3, "misc": F.when(tex % 5 == 0, dds.M_CUBE).otherwise(0), "array_size": 1}, payload)
    plain = dds.compose(common | {"pf_fourcc": 0x31545844, "caps2": F.when(tex % 4 == 0, dds.C_CUBE).otherwise(0)}, None, payload)
    files = views.tex_part(spark, sf_dir).select("tex", F.when(tex % 3 == 0, wide).otherwise(plain).alias("content"))
    length = F.octet_length("content") - F.col("payload_offset")
    return dds.parse(files).select("tex", "height", "width", "mip_map_count", "dxgi", "is_cube", "payload_offset", length.cast("long").alias("payload_bytes"))


def _random_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen bytes for each event, by md5 of its number."""
    return views.table(spark, sf_dir, "events").select("event_id", F.unhex(F.md5(F.col("event_id").cast("string"))).alias("payload"))


@_query()
def bc7_decode(spark, sf_dir):
    px = dds.decode(_random_blocks(spark, sf_dir).select("event_id", F.lit("bc7").alias("content"), F.lit(4).alias("width"), F.lit(4).alias("height"), "payload"))
    return px.select("event_id", F.hex("rgba").alias("rgba"), F.crc32("rgba").alias("checksum"))


@_query()
def decode_all_contents(spark, sf_dir):
    """One NPOT slice (5x3) of every content class for each event: four blocks' worth of bytes."""
    four = F.concat(*[F.unhex(F.md5(F.concat(F.col("event_id").cast("string"), F.lit(f"-{k}")))) for k in range(4)])
    names = F.explode(F.array(*[F.lit(n) for n, _ in formats.CONTENT]))
    rows = views.table(spark, sf_dir, "events").select("event_id", four.alias("payload")).select("event_id", names.alias("content"), F.lit(5).alias("width"), F.lit(3).alias("height"), "payload")
    return dds.decode(rows).select("event_id", "content", F.crc32("rgba").alias("checksum"), "decode_error")


@_query()
def encode_psnr(spark, sf_dir):
    """Every part's synthetic 16x16 image, encoded and decoded in each class, with its squared error."""
    import numpy as np
    import pandas as pd

    from ..functions import blocks, encoders

    channels = {"bc1": 3, "bc4u": 1, "bc5u": 2}

    def measure(images):
        """Bytes and squared error of each image in each class."""
        out = []
        for name in encoders.ENCODERS:
            data = encoders.encode_many(name, images)
            back = np.stack([np.frombuffer(px, np.uint8).reshape(16, 16, 4) for px, _ in blocks.decode_many(name, [(d, 16, 16) for d in data])])
            n = channels.get(name, 4)
            squared = ((images[..., :n].astype(int) - back[..., :n]) ** 2).sum((1, 2, 3))
            out.append(np.stack([[len(d) for d in data], squared], 1))
        return np.stack(out, 1)

    def run(batches):
        y, x = np.mgrid[:16, :16]
        known = {}
        for pdf in batches:
            for a in range(0, len(pdf), 256):
                keys = pdf["p_partkey"].to_numpy()[a : a + 256]
                key = keys[:, None, None]
                images = np.stack(np.broadcast_arrays((x * 16 + key) % 256, (y * 16 + key * 3) % 256, (x * y + key * 7) % 256, (200 + x + y) % 256), -1).astype(np.uint8)
                # equal images are measured once, as long as they are remembered
                names = [image.tobytes() for image in images]
                if len(known) > 4096:
                    known = {}
                new = {name: i for i, name in enumerate(names) if name not in known}
                if new:
                    known |= dict(zip(new, measure(images[list(new.values())]), strict=True))
                told = np.stack([known[name] for name in names]).reshape(-1, 2)
                classes = list(encoders.ENCODERS)
                yield pd.DataFrame({"tex": np.repeat(keys, len(classes)), "content": classes * len(keys), "bytes": told[:, 0], "squared": told[:, 1], "n": [channels.get(c, 4) * 256 for c in classes] * len(keys)})

    done = views.table(spark, sf_dir, "part").select("p_partkey").mapInPandas(run, "tex long, content string, bytes long, squared long, n long")
    return done.withColumn("psnr", F.round(pixels.psnr(F.col("squared"), F.col("n")), 6))


@_query()
def lru_pool(spark, sf_dir):
    """Four runs with the same requests; each run is one state machine."""
    wanted = _requests(spark, sf_dir).withColumn("content_id", F.col("tex") % 10).join(F.broadcast(_content(spark)), "content_id")
    sized = wanted.withColumn("bytes", residency.level_bytes(F.lit(64).cast("long"), F.col("mip"), F.col("block_bytes")))
    runs = sized.withColumn("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))))
    return pool.replay(runs.select("run_id", "frame", "tex", "mip", "bytes"), 1 << 18, 1 << 20).withColumn("resident_pct", F.round("resident_pct", 9))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
