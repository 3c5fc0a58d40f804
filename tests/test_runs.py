"""Runs, board, scenarios: round trips and plain versions."""

import math

import numpy as np

from blockloom.plans import runs, scenario

MASK = (1 << 64) - 1


def plain_draws(seed, n):
    state, out = (seed + scenario.GOLDEN) & MASK, []
    for _ in range(n):
        state = (state + scenario.GOLDEN) & MASK
        z = state
        z = (z ^ z >> 30) * scenario.M1 & MASK
        z = (z ^ z >> 27) * scenario.M2 & MASK
        out.append(z ^ z >> 31)
    return out


def test_draws():
    assert scenario.draws(42, np.arange(50)).tolist() == plain_draws(42, 50)
    assert scenario.draws(MASK, np.arange(5)).tolist() == plain_draws(MASK, 5)


def plain_camera(kind, frame, dt):
    """In double precision, as the script says."""
    t = frame * dt
    at = lambda seed, half: [-half + (x >> 40) / (1 << 24) * 2 * half for x in plain_draws(seed, 2)]
    if kind == "traverse":
        return 240 * math.sin(t * 0.35), 240 * math.cos(t * 0.2149)
    if kind == "hub":
        return 70 * math.cos(t * 0.6), 70 * math.sin(t * 0.6)
    if kind == "arrival":
        x, z = at(0xA2211AA0 ^ frame // 1200, 300)
        return x + frame % 1200 * dt * 14, z + frame % 1200 * dt * 5
    lap, leg, lt = frame // 10800, frame % 10800 // 1800, frame % 1800 * dt
    x, z = at(0x51551043 ^ lap, 180)
    if leg == 0:
        return x + 18 * math.cos(lt / 4), z + 18 * math.sin(lt / 4)
    if leg == 1:
        return x + 0.28 * lt * lt, z + 0.28 * lt * lt * 0.4
    if leg == 2:
        return 240 * math.sin(lt * 0.35 + lap), 240 * math.cos(lt * 0.2149 + lap)
    if leg == 3:
        x, z = at(0xD06E5EED ^ lap << 8, 300)
        k = 1 - (1 - lt / 30) ** 3
        return x + (1 - k) * 150, z + (1 - k) * 60
    if leg == 4:
        return x + 60 + 9 * math.cos(lt / 2), z + 24 + 9 * math.sin(lt / 2)
    return x + 60 * (1 - lt / 30), z + 24 * (1 - lt / 30)


def test_cameras(spark):
    dt = 1 / 60
    frames = np.arange(0, 32400, 97)
    for kind in ("traverse", "hub", "arrival", "mission"):
        x, z = scenario.camera(kind, frames, dt)
        assert x.dtype == np.float32
        want = np.array([plain_camera(kind, int(f), dt) for f in frames])
        assert np.abs(np.stack([x, z], 1) - want).max() < 0.05
    rows = scenario.cameras(spark.range(3).withColumnRenamed("id", "frame"), "hub", dt).collect()
    assert [(r.frame, r.cam_y) for r in rows] == [(0, 0.0), (1, 0.0), (2, 0.0)] and rows[0].cam_x == 70.0


def test_request_hashes(spark):
    from blockloom.functions.hashes import fnv1a

    rows = [(0, 1, 2), (0, 1, 0), (0, 0, 5), (3, 7, 1)]
    got = {r.frame: r.request_hash for r in scenario.request_hashes(spark.createDataFrame(rows, "frame long, tex long, mip long")).collect()}
    h = fnv1a(b"".join((t << 32 | m).to_bytes(8, "little") for t, m in [(0, 5), (1, 0), (1, 2)]))
    assert got[0] == f"{h:016x}" and set(got) == {0, 3}


def test_requests_with_heights(spark):
    from blockloom.plans.residency import requests

    rng = np.random.default_rng(3)
    world = [(i, *(float(v) for v in rng.uniform(-300, 300, 3)), 4) for i in range(80)]
    eyes = [(f, *(float(v) for v in rng.uniform(-200, 200, 3))) for f in range(6)]
    got = {(r.frame, r.tex, r.mip) for r in requests(spark.createDataFrame(world, "tex long, x double, y double, z double, mips long"), spark.createDataFrame(eyes, "frame long, cam_x double, cam_y double, cam_z double")).collect()}
    want = set()
    for f, *eye in eyes:
        for i, *place, mips in world:
            d = math.dist(eye, place)
            if d <= 260:
                want |= {(f, i, m) for m in range(min(int(math.floor(max(0.0, math.log2(max(1.0, d / 40))) + 0.5)), mips - 1), mips)}
    assert got == want


def test_runs_round_trip(spark, tmp_path):
    ddl = "run_id string, " + ", ".join(f"{c} {'double' if f.endswith('f') else 'long'}" for c, f in runs.FRAME_FORMATS.items())
    rows = [(f"r{k}", *[float(i) + 0.15625 if f.endswith("f") else i + k for f in runs.FRAME_FORMATS.values()]) for k in range(3) for i in range(4)]
    frames = spark.createDataFrame(rows, ddl)
    fields = spark.createDataFrame([("r0", "arm", "a"), ("r0", "seed", "7 8"), ("r1", "arm", "b")], "run_id string, key string, value string")
    runs.write_runs(frames, fields, str(tmp_path))
    back, held, rejected = runs.load_runs(spark, str(tmp_path))
    assert [r.run_id for r in rejected.collect()] == ["r2"]
    assert sorted(map(tuple, held.select("run_id", "key", "value").collect())) == [("r0", "arm", "a"), ("r0", "seed", "7 8"), ("r1", "arm", "b")]
    own = back.where("run_id = 'r1'").orderBy("frame").collect()
    assert [r.frame for r in own] == [1, 2, 3, 4] and own[0].sim_time == 0.1562 and own[3].upload_hash == f"{4:016x}"


def test_percentiles(spark):
    rng = np.random.default_rng(5)
    rows = [(k, float(v)) for k in range(3) for v in np.round(rng.lognormal(-3, 3, 400 + k), 3)] + [(3, 7.0), (4, float("nan")), (4, 0.0), (5, None)]
    got = {r.k: tuple(r)[1:] for r in runs.percentiles(spark.createDataFrame(rows, "k long, v double"), ["k"], "v", {"a": 0.5, "b": 0.99, "c": 1.0}).collect()}
    for k in range(4):
        own = sorted(v for j, v in rows if j == k)
        assert got[k] == tuple(own[max(1, math.ceil(p * len(own))) - 1] for p in (0.5, 0.99, 1.0))
    assert got[4][0] == 0.0 and math.isnan(got[4][2]) and 5 not in got


def test_markdown(spark):
    made = spark.createDataFrame([(a, r, *[float(r + (a == "b") * 10) + 1 for _ in runs.METRICS]) for a in "ab" for r in range(3)], "arm string, rep long, " + ", ".join(f"{m} double" for m in runs.METRICS))
    held = spark.createDataFrame([(a, r, "t", "medium" if r else "high") for a in "ab" for r in range(3)], "arm string, rep long, trace_hash string, tier string")
    text = runs.markdown(held, made, "a", "b")
    assert "Comparability: REJECT" in text and "tier has 2 values" in text and "Work parity: PASS (t)" in text
    assert "| p99_cpu_ms | 2.000 | 12.000 | -83.33% | ±200.00% | inside the noise |" in text
    assert (runs.shown(None), runs.shown(123.456, "ms"), runs.shown(0.5)) == ("—", "123.5 ms", "0.5000")
