"""Whole containers, encoded and decoded again: arrays, cubes, volumes, parts; damaged files; image loaders."""

import io
import struct
import zlib

import numpy as np
import pytest

from blockloom.functions import alpha, blocks, encoders
from blockloom.sources import dds, images, textures

IMAGE = "key string, class string, width long, height long, depth long, mips long, layers long, is_cube boolean, rgba binary"


def pixels(w, h, n, seed):
    y, x, z = np.mgrid[:h, :w, :n]
    rows = np.stack([(x * 9 + z * 20 + seed) % 256, (y * 11 + z * 5) % 256, (x + y + z) * 6 % 256, 255 - (x % 4)], -1).astype(np.uint8)
    return np.ascontiguousarray(rows.transpose(2, 0, 1, 3))


GRID = [("flat", 8, 8, 1, 1, 1, False), ("odd", 13, 7, 1, 1, 1, False), ("levels", 16, 16, 1, 5, 1, False), ("array", 8, 4, 1, 1, 3, False), ("cube", 8, 8, 1, 2, 6, True), ("volume", 8, 8, 4, 1, 1, False), ("cubes", 4, 4, 1, 1, 12, True)]


def test_round_trip(spark):
    rows = [(f"{c}-{name}", c, w, h, d, m, n, cube, pixels(w, h, d * n, len(c)).tobytes()) for c in textures.WRITTEN for name, w, h, d, m, n, cube in GRID]
    made = textures.encode_files(spark.createDataFrame(rows, IMAGE), "key").cache()
    assert made.where("error is not null").count() == 0
    got = {}
    for r in textures.decode_files(made, "key").collect():
        assert r.error is None, r
        got.setdefault(r.key, []).append(r)
    for key, c, w, h, d, m, n, cube, rgba in rows:
        own = sorted(got[key], key=lambda r: (r.layer, r.face, r.mip))
        faces = 6 if cube else 1
        # a cube's layer count is written as cubes
        assert [(r.layer, r.face, r.mip) for r in own] == [(a, f, k) for a in range(n // faces) for f in range(faces) for k in range(m)]
        source = np.frombuffer(rgba, np.uint8).reshape(n, d, h, w, 4)
        for r in own:
            image = source[r.layer * faces + r.face]
            for _ in range(r.mip):
                image = encoders.halve(image)
            back = np.frombuffer(r.rgba, np.uint8).reshape(image.shape)
            assert (r.depth, r.height, r.width) == image.shape[:3]
            use = {"bc4u": 1, "bc4s": 1, "bc5u": 2, "bc5s": 2, "bc1": 3}.get(c, 4)
            if c in ("rgba8", "bgra8"):
                assert (back == image).all()
                continue
            seen = back[..., :use].astype(int)
            if c.endswith("s") and c != "bc7":
                seen = alpha.to_unorm(np.where(seen > 127, seen - 256, seen))
            error = ((seen - image[..., :use].astype(int)) ** 2).mean()
            assert error < 0.09 * 255**2, (key, error)


def test_quality(spark):
    px = pixels(32, 32, 1, 3)[0]
    for c, floor in (("bc4u", 35), ("bc4s", 35), ("bc5u", 33), ("bc5s", 33)):
        data, error = encoders.encode_surface(c, px.tobytes(), 32, 32)
        assert error is None
        back = np.frombuffer(blocks.decode_surface(c, data, 32, 32)[0], np.uint8).reshape(32, 32, 4).astype(int)
        n = 1 if c.startswith("bc4") else 2
        seen = alpha.to_unorm(np.where(back > 127, back - 256, back)) if c.endswith("s") else back
        mse = ((seen[:, :, :n] - px[:, :, :n]) ** 2).mean()
        assert 10 * np.log10(255**2 / mse) > floor


def test_alpha_search():
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.integers(0, 256, (60, 16)), rng.integers(90, 120, (60, 16)), rng.choice([0, 40, 200, 255], (60, 16)), np.full((3, 16), 77)])
    for signed in (False, True):
        searched, plain = (alpha.Search(values, signed) for _ in range(2))
        searched.run()
        rows, low, high = np.arange(len(values)), plain.ends.min(1), plain.ends.max(1)
        plain.both(rows, high, low)
        assert (searched.error <= plain.error).all() and searched.error.sum() < 0.97 * plain.error.sum()
        back = blocks.decode_bc4(alpha.encode(values, signed), signed)[:, :, 0].astype(int)
        seen = alpha.to_unorm(np.where(back > 127, back - 256, back)) if signed else back
        assert (((seen - values) ** 2).sum(1) == searched.error).all()
        # two values that are ends themselves are exact
        pair = alpha.Search(np.tile([31, 190], (1, 8)), signed)
        pair.run()
        assert pair.error[0] <= (0 if not signed else 2 * 16)
    assert (alpha.to_unorm(alpha.to_snorm(np.arange(256))) - np.arange(256)).__abs__().max() <= 1


def test_block_rows(spark):
    px = pixels(10, 22, 1, 5)[0]
    rows = [(c, encoders.encode_surface(c, px.tobytes(), 10, 22)[0], 10, 22) for c in ("bc1", "bc7", "bgra8")]
    whole = {c: blocks.decode_surface(c, data, w, h)[0] for c, data, w, h in rows}
    table = spark.createDataFrame(rows, "class string, payload binary, width long, height long")
    got = textures.decode_rows(textures.block_row_ranges(table, 2)).orderBy("class", "first_row").collect()
    for c in whole:
        assert b"".join(bytes(r.rgba) for r in got if r["class"] == c) == whole[c]
    assert blocks.decode_block_rows("bc1", rows[0][1], 10, 22, 2, 7) == (None, "OutOfBounds")
    assert blocks.decode_block_rows("bc1", rows[0][1], 10, 22, 3, 3) == (b"", None)


def test_damaged_files(spark):
    px = pixels(8, 8, 6, 1)
    made = textures.encode_files(spark.createDataFrame([("a", "bc1", 8, 8, 1, 2, 6, True, px.tobytes())], IMAGE), "key").first().content
    made = bytes(made)
    claim = made[:140] + struct.pack("<I", 0x7FFFFFFF) + made[144:]
    files = [("good", made), ("cut", made[:-1]), ("short", made[:100]), ("magic", b"XXXX" + made[4:]), ("claims", claim), ("format", made[:128] + struct.pack("<I", 119) + made[132:]), ("video", made[:128] + struct.pack("<I", 103) + made[132:]), ("empty", b""), ("dimension", made[:132] + struct.pack("<I", 9) + made[136:])]
    got: dict[str, list] = {}
    for r in textures.decode_files(spark.createDataFrame(files, "key string, content binary"), "key").collect():
        got.setdefault(r.key, []).append(r.error)
    assert got["good"] == [None] * 12 and got["cut"] == [None] * 11 + ["TruncatedData"]
    assert got["short"] == ["Io"] and got["magic"] == ["BadMagic"] and got["format"] == ["InvalidField"] and got["video"] == ["UnsupportedFormat"] and got["empty"] == ["Io"] and got["dimension"] == ["InvalidField"]
    assert got["claims"][:12] == [None] * 12 and set(got["claims"][12:]) <= {"TruncatedData", "OutOfBounds"} and len(got["claims"]) == 13
    texts = {r.key: r.info for r in textures.info(spark.createDataFrame(files, "key string, content binary")).collect()}
    assert texts["good"].startswith("BC1_UNorm 8x8x1, 2 levels, 1 layers, 6 faces") and texts["magic"] == "BadMagic"


def test_layout_errors(spark):
    bad = [("zero", "bc1", 0, 4, 1, 1, 1, False), ("mips", "bc1", 4, 4, 1, 0, 1, False), ("cube", "bc1", 4, 4, 1, 1, 5, True), ("deep", "bc1", 4, 4, 2, 1, 6, True), ("both", "bc1", 4, 4, 2, 1, 2, False)]
    rows = [(*b, bytes(4096)) for b in bad] + [("class", "etc2", 4, 4, 1, 1, 1, False, bytes(64)), ("few", "bc1", 4, 4, 1, 1, 1, False, bytes(63))]
    got = {r.key: r.error for r in textures.encode_files(spark.createDataFrame(rows, IMAGE), "key").collect()}
    assert got == dict.fromkeys([b[0] for b in bad], "InvalidField") | {"class": "UnsupportedFormat", "few": "TruncatedData"}


def test_files_written_and_read(spark, tmp_path):
    px = pixels(8, 8, 1, 1)
    made = textures.encode_files(spark.createDataFrame([(f"{i}.dds", "bc3", 8, 8, 1, 1, 1, False, px.tobytes()) for i in range(3)], IMAGE), "key")
    dds.write_dds(made.withColumnRenamed("key", "name"), str(tmp_path / "out"))
    back = dds.read_dds(spark, str(tmp_path / "out"))
    assert back.count() == 3 and {(r.width, r.height, r.dxgi, r.error) for r in back.collect()} == {(8, 8, 77, None)}
    assert {r.error for r in dds.read_dds(spark, str(tmp_path / "out"), max_payload=63).collect()} == {"SizeLimitExceeded"}
    assert {r.error for r in dds.read_dds(spark, str(tmp_path / "out"), max_payload=64).collect()} == {None}


def png(rows, w, h, depth, colour, extra=b""):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, 0)) + extra + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def filtered(px, kinds):
    """PNG rows by each filter, from plain arithmetic."""
    h, w, n = px.shape
    out = io.BytesIO()
    for y in range(h):
        line, above = px[y].ravel().astype(int), (px[y - 1].ravel() if y else np.zeros(w * n, np.uint8)).astype(int)
        left = np.concatenate([np.zeros(n, int), line[:-n]])
        corner = np.concatenate([np.zeros(n, int), above[:-n]])
        k = kinds[y % len(kinds)]
        p = left + above - corner
        order = np.stack([abs(p - left), abs(p - above), abs(p - corner)]).argmin(0)
        guess = [0 * line, left, above, (left + above) // 2, np.choose(order, [left, above, corner])][k]
        out.write(bytes([k]) + ((line - guess) % 256).astype(np.uint8).tobytes())
    return out.getvalue()


def test_png():
    rng = np.random.default_rng(4)
    px = rng.integers(0, 256, (10, 7, 4)).astype(np.uint8)
    assert (images.read_png(png(filtered(px, [0, 1, 2, 3, 4]), 7, 10, 8, 6)) == px).all()
    grey = px[:, :, :1]
    assert (images.read_png(png(filtered(grey, [4, 3]), 7, 10, 8, 0)) == images.rgba(grey)).all()
    wide = png(b"".join(b"\0" + b"".join(bytes([v, 99]) for v in row.ravel()) for row in px[:, :, :3]), 7, 10, 16, 2)
    assert (images.read_png(wide)[:, :, :3] == px[:, :, :3]).all()
    with pytest.raises(images.Unreadable):
        images.read_png(b"no")


def tiff(order, w, h, n, bits, body):
    fields = [(256, 3, w), (257, 3, h), (258, 3, bits), (259, 3, 1), (273, 4, 8), (277, 3, n), (279, 4, len(body))]
    entry = lambda t, k, v: struct.pack(order + "HHI", t, k, 1) + (struct.pack(order + "HH", v, 0) if k == 3 else struct.pack(order + "I", v))
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(body)) + body + struct.pack(order + "H", len(fields)) + b"".join(entry(*f) for f in fields) + bytes(4)


def test_tiff_and_hdr(spark, tmp_path):
    rng = np.random.default_rng(6)
    px = rng.integers(0, 256, (5, 6, 3)).astype(np.uint8)
    assert (images.read_tiff(tiff("<", 6, 5, 3, 8, px.tobytes()))[:, :, :3] == px).all()
    assert (images.read_tiff(tiff(">", 6, 5, 3, 16, (px.astype(">u2") * 256 + 7).astype(">u2").tobytes()))[:, :, :3] == px).all()
    line = b"\x02\x02\x00\x09" + b"".join(bytes([128 + 9, v]) for v in (128, 64, 0)) + bytes([4, 129, 129, 129, 129, 128 + 5, 130])
    hdr = b"#?RADIANCE\nFORMAT=32-bit_rle_rgbe\n\n-Y 2 +X 9\n" + line * 2
    got = images.read_hdr(hdr)
    assert got.shape == (2, 9, 3) and got[0, 0].tolist() == [1.0, 0.5, 0.0] and got[1, 8].tolist() == [2.0, 1.0, 0.0]
    for name, data in (("Rock_Color.png", png(filtered(px, [1]), 6, 5, 8, 2)), ("sky.hdr", hdr), ("bad.png", b"x"), ("notes.txt", b"x")):
        (tmp_path / name).write_bytes(data)
    rows = {r.path.rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert (rows["Rock_Color.png"].role, rows["Rock_Color.png"].width, rows["Rock_Color.png"].error) == ("albedo", 6, None)
    assert len(rows["sky.hdr"].floats) == 2 * 9 * 12 and rows["bad.png"].error == "InvalidField" and rows["notes.txt"].error == "UnsupportedFormat"


def test_many_layers_are_listed(spark):
    from blockloom.operators.surfaces import subresources

    rows = [(1, 4, 4, 1, 8, 8, 5000, 1, 40000), (2, 4, 4, 1, 8, 8, 1, 6, 47)]
    got = subresources(spark.createDataFrame(rows, "tex long, width long, height long, mips long, size0 long, least long, layers long, faces long, payload_bytes long"))
    rows = {(r.tex, r.layer, r.face): (r.offset, r.error) for r in got.collect()}
    assert len(rows) == 5006 and rows[1, 4999, 0] == (39992, None)
    assert [rows[2, 0, f] for f in (0, 4, 5)] == [(0, None), (32, None), (40, "TruncatedData")]
