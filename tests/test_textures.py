"""Texture operators: kernels against scalar versions, containers, the pool, and every query against its SQL."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from blockloom.functions import blocks, formats, hashes, palette
from blockloom.plans import catalog
from blockloom.sources import dds
from blockloom.streaming.pool import Pool, replay, replay_stream

DATA = Path("/root/testdata/sf0.001")


def bit_field(block, first, width):
    return (int.from_bytes(block, "little") >> first) & ((1 << width) - 1)


def scalar_bc7(block):
    """A plain reader of one block, field after field."""
    if not block[0]:
        return [(0, 0, 0, 0)] * 16
    mode = (block[0] & -block[0]).bit_length() - 1
    m, at = blocks.MODES[mode], mode + 1

    def take(n):
        nonlocal at
        at += n
        return bit_field(block, at - n, n)

    shape, rotation, select = take(m.partition), take(m.rotation), take(m.select)
    channels = 4 if m.alpha else 3
    ends = [[0] * 4 for _ in range(2 * m.subsets)]
    for c in range(channels):
        for e in ends:
            e[c] = take(m.alpha if c == 3 else m.colour)
    if m.own_p:
        ps = [take(1) for _ in ends]
    elif m.shared_p:
        ps = [p for p in [take(1) for _ in range(m.subsets)] for _ in range(2)]
    else:
        ps = None
    for k, e in enumerate(ends):
        for c in range(channels):
            width = m.alpha if c == 3 else m.colour
            if ps:
                e[c], width = e[c] * 2 + ps[k], width + 1
            e[c] = (e[c] << (8 - width)) | (e[c] << (8 - width) >> width)
    anchors = blocks._ANCHORS[m.subsets][shape].tolist()
    first = [take(m.index - (p in anchors)) for p in range(16)]
    second = [take(m.second - (p == 0)) for p in range(16)] if m.second else None
    out = []
    for p in range(16):
        a, b = ends[2 * blocks.SUBSETS[m.subsets][shape][p]], ends[2 * blocks.SUBSETS[m.subsets][shape][p] + 1]
        wc = blocks.WEIGHTS[m.index][first[p]]
        wa = blocks.WEIGHTS[m.second][second[p]] if second else wc
        if select:
            wc, wa = wa, wc
        px = [((64 - w) * x + w * y + 32) >> 6 for x, y, w in zip(a, b, (wc, wc, wc, wa), strict=True)]
        if not m.alpha:
            px[3] = 255
        if rotation:
            px[rotation - 1], px[3] = px[3], px[rotation - 1]
        out.append(tuple(px))
    return out


def test_bc7_all_modes():
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, (450, 16), dtype=np.uint8)
    for i in range(450):
        mode = i % 9
        data[i, 0] = 0 if mode == 8 else int(data[i, 0]) >> (mode + 1) << (mode + 1) | 1 << mode
    got = blocks.decode_bc7(data)
    for row, px in zip(data, got, strict=True):
        assert [tuple(map(int, p)) for p in px] == scalar_bc7(bytes(row))


def test_palettes_known_values():
    assert blocks._ramp(np.array([[60, 133, 0, 0, 0, 0, 0, 0]], np.uint8), "unsigned")[0, 0] == 60
    divided = blocks._ramp(np.array([[60, 133, *([0b10010010] * 6)]], np.uint8), "divided")
    weighted = blocks._ramp(np.array([[60, 133, *([0b10010010] * 6)]], np.uint8), "unsigned")
    assert set(divided[0]) | set(weighted[0]) <= set(range(256))
    opaque = blocks.decode_bc1(np.array([[0, 0xF8, 0, 0, 0, 0, 0, 0]], np.uint8))
    assert (opaque[0] == [255, 0, 0, 255]).all()
    through = blocks.decode_bc1(np.array([[0, 0, 0, 0xF8, 255, 255, 255, 255]], np.uint8))
    assert (through[0] == 0).all()
    assert (blocks.half_to_float(np.arange(0x7C00)) == np.arange(0x7C00).astype(np.uint16).view(np.float16).astype(np.float32)).all()


def test_decode_surface_contract():
    assert blocks.decode_surface("bc1", b"", 4, 4) == (None, "TruncatedData")
    assert blocks.decode_surface("bc1", b"", 0, 4) == (None, "InvalidField")
    assert blocks.decode_surface("astc", b"", 4, 4) == (None, "UnsupportedFormat")
    assert blocks.decode_surface("bgra8", bytes([1, 2, 3, 4]), 1, 1)[0] == bytes([3, 2, 1, 4])
    assert len(blocks.decode_surface("bc7", bytes(32), 5, 3)[0]) == 60


def test_hashes():
    assert hashes.fnv1a(b"") == hashes.OFFSET and hashes.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    rows = np.frombuffer(b"abcabd", np.uint8).reshape(2, 3)
    assert hashes.fnv1a_rows(rows).tolist() == [hashes.fnv1a(b"abc"), hashes.fnv1a(b"abd")]
    assert hashes.combine([3, 1, 2]) == hashes.combine([2, 3, 1])


def test_formats():
    rows = {r["name"]: r for r in formats.dxgi_rows()}
    assert rows["BC1_UNorm"]["code"] == 71 and rows["BC7_UNorm_sRGB"]["code"] == 99 and rows["V408"]["code"] == 132
    assert rows["R16G16B16A16_Float"]["bits_per_pixel"] == 64 and rows["D32_Float_S8X24_UInt"]["bits_per_pixel"] == 64
    assert rows["BC6H_SF16"]["wgpu_name"] == "Bc6hRgbFloat" and rows["BC5_SNorm"]["vulkan_name"] == "VK_FORMAT_BC5_SNORM_BLOCK"


def test_container_errors(spark):
    good = spark.range(1).select(dds.compose({"height": 4, "width": 8, "pf_flags": dds.P_FOURCC, "pf_fourcc": dds.DX10}, {"dxgi": 71}, F.lit(b"12345678")).alias("content")).first().content
    rows = [(bytes(good),), (bytes(good[:100]),), (b"",), (b"XXXX" + bytes(good[4:]),), (bytes(good[:4]) + b"\0" * 200,), (bytes(good[:140]),), (None,)]
    got = dds.parse(spark.createDataFrame(rows, "content binary")).collect()
    assert [r.error for r in got] == [None, "Io", "Io", "BadMagic", "InvalidField", "Io", "Io"]
    assert (got[0].width, got[0].height, got[0].dxgi, got[0].payload_offset, got[0].mip_map_count) == (8, 4, 71, 148, None)
    tagged = spark.createDataFrame([(good,)], "content binary").select(dds.retag("content", 98).alias("content"))
    assert dds.parse(tagged).first().dxgi == 98 and len(tagged.first().content) == len(good)


def test_array_stride_tail(spark):
    from blockloom.operators.surfaces import array_stride

    rows = [(4096, 3, 8), (4096, 40, 8), (4096, 0, 8), (1 << 33, 2, 8)]
    got = [r[0] for r in spark.createDataFrame(rows, "size0 long, mips long, least long").select(array_stride()).collect()]
    assert got == [4096 + 1024 + 256, sum(max(8, 4096 >> (2 * k)) for k in range(40)), 0, 0xFFFFFFFF]


def test_pool_skips_and_evicts():
    pool = Pool(100, 150)
    assert pool.step(0, [(1, 0, 80), (1, 1, 30), (2, 0, 20)])[1:4] == (100, 2, 0)
    assert pool.step(1, [(3, 0, 90)])[3] == 1
    assert (1, 0) not in pool.resident and (2, 0) in pool.resident
    assert pool.step(2, [])[5] == 1.0


def test_pool_batch_and_stream(spark, tmp_path):
    rows = [(r, f, t, m, 10 * (m + 1)) for r in range(2) for f in range(6) for t in range(3) if (f + t + r) % 3 for m in range(2)]
    schema = "run_id long, frame long, tex long, mip long, bytes long"
    df = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, replay(df, 40, 60).collect()))
    for f in range(6):
        df.where(f"frame = {f}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    query = replay_stream(stream, 40, 60).writeStream.format("memory").queryName("pool").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, spark.table("pool").collect())) == want


def _key(row):
    return tuple((v is None, round(v, 9) if isinstance(v, float) and math.isfinite(v) else str(v)) for v in row)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("events", "lineitem", "part", "documents"):
        found = DATA / f"{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{found}{'/*.parquet' if found.is_dir() else ''}'")
    got = catalog.queries()[name](spark, str(DATA))
    want = con.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(_key, got.select(*columns).collect())) == sorted(map(_key, want.fetchall()))


def test_palette_round_trip(spark):
    px = spark.range(256).select(F.col("id").alias("r"), F.col("id").alias("g"), F.col("id").alias("b"))
    back = px.select("r", *[x.alias(n) for n, x in zip("xyz", palette.replicate565(palette.quantise565("r", "g", "b")), strict=True)]).collect()
    assert all(abs(v.x - v.r) <= 7 and abs(v.y - v.r) <= 3 for v in back)
