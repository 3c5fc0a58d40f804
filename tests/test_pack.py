"""Packs: images, cooking, hashes and the manifest."""

import numpy as np
import pytest

from blockloom.functions import hashes
from blockloom.plans import pack
from blockloom.sources import textures


def test_noise():
    y, x = np.mgrid[:8, :8].astype(np.float32) / np.float32(3)
    n = pack.noise(7, x, y)
    assert n.dtype == np.float32 and 0 <= n.min() < n.max() < 1
    at = pack.lattice(5, np.array([3]), np.array([-2]))[0]
    plain = hashes.fnv1a((3).to_bytes(4, "little") + (-2).to_bytes(4, "little", signed=True), 5)
    assert at == np.float32(plain >> 40) / np.float32(1 << 24)
    assert (pack.noise(7, x[:1, :1], y[:1, :1], 1) == pack.lattice(7, np.array([[0]]), np.array([[0]]))).all()


def test_bulk():
    data = bytes(range(100))
    mask = (1 << 64) - 1
    turn = lambda v, n: (v << n | v >> 64 - n) & mask
    seed = 0x0123456789ABCDEF
    lanes = [turn(seed, 16 * i) if i else seed for i in range(4)]
    lanes = [a ^ b for a, b in zip(lanes, hashes.LANES)]
    for at in range(0, 96, 8):
        i = at // 8 % 4
        lanes[i] = (lanes[i] ^ int.from_bytes(data[at : at + 8], "little")) * hashes.PRIME & mask
    h = lanes[0] ^ turn(lanes[1], 17) ^ turn(lanes[2], 34) ^ turn(lanes[3], 51)
    assert hashes.bulk(data, seed) == hashes.fnv1a(data[96:], h * hashes.PRIME & mask ^ 100)
    assert hashes.bulk(data[:64], 1) != hashes.bulk(data[:64], 2) and hashes.bulk(b"", 0) != hashes.bulk(b"\0", 0)


def test_cook(spark, tmp_path):
    made = pack.cook(spark, "high", 12, 16).cache()
    rows = {r.tex: r for r in made.collect()}
    assert [rows[i].content for i in range(12)] == ["bc7", "bc7", "bc5u", "bc4u", "bc1", "bc1", "bc5u", "bc4u", "bc6h", "bc7", "bc5u", "bc4u"]
    assert all(r.mips == 5 and int(r.hash, 16) == hashes.fnv1a(bytes(r.data)) and len(r.data) == r.bytes for r in rows.values())
    done = textures.decode_files(made, "tex", "data").collect()
    assert len(done) == 60 and all(r.error is None for r in done)
    first = next(r for r in done if r.tex == 3 and r.mip == 0)
    source = pack.image("bc4u", 3, 16)
    assert np.abs(np.frombuffer(first.rgba, np.uint8).reshape(16, 16, 4)[:, :, 0].astype(int) - source[:, :, 0]).max() <= 12
    lines = pack.manifest(made, "high", 16, 4.0)
    fields, back = pack.parse_manifest(spark.createDataFrame([(x,) for x in [*lines, "texture broken", "other words"]], "value string"))
    held = {r.key: r.value for r in fields.collect()}
    assert held == {"tier": "high", "size": "16", "rdo_lambda": "4", "total_bytes": str(sum(r.bytes for r in rows.values())), "hash": pack.pack_hash(made)}
    got = back.collect()
    assert sorted((r.file, r.bytes, r.hash) for r in got if r.error is None) == sorted((r.file, r.bytes, r.hash) for r in rows.values()) and sum(r.error is not None for r in got) == 1
    with pytest.raises(ValueError):
        pack.cook(spark, "high", 1, 12)
