"""Queries over benchmark runs and the simulator's scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import runs, scenario, views
from .catalog import _query, _values

_FRAMES = """SELECT user_id % 3 AS arm, user_id % 15 // 3 AS rep, event_id AS frame, event_id / 64.0 AS sim_time, value AS cpu_frame_ms, value * 0.5 AS stream_cpu_ms, value * 0.25 AS parse_ms, value * 0.125 AS upload_ms,
  CASE WHEN value > 1.0 THEN 1 ELSE 0 END AS hitch, event_id % 97 + 0.5 AS peak_rss_mb, event_id % 7 AS alloc_count, event_id % 1000 * 4096 AS bytes_uploaded FROM events"""
_RUNS_SQL = f"""(SELECT arm::VARCHAR AS arm, rep, 'traverse' AS scenario, '8' AS workers, CASE WHEN arm = 2 AND rep = 0 THEN 'high' ELSE 'medium' END AS tier, CASE WHEN rep = 4 THEN NULL ELSE '64' END AS cpus, n::VARCHAR AS frames, (arm * 10)::VARCHAR AS exe_len, CASE WHEN rep < 2 THEN 'a' ELSE 'b' END AS provider,
  CASE WHEN arm = 1 AND rep = 3 THEN NULL ELSE 'h' || (rep % 2)::VARCHAR END AS trace_hash FROM (SELECT arm, rep, COUNT(*) AS n FROM ({_FRAMES}) GROUP BY arm, rep))"""
_METRICS_SQL = f"""(SELECT arm::VARCHAR AS arm, rep, CASE WHEN rep = 2 THEN 'NaN'::DOUBLE ELSE arm * 1.5 + rep END AS cpu_secs, SUM(stream_cpu_ms) AS stream_ms_total, SUM(parse_ms) AS parse_ms_total, SUM(upload_ms) AS upload_ms_total, quantile_disc(cpu_frame_ms, 0.5) AS median_cpu_ms, quantile_disc(cpu_frame_ms, 0.99) AS p99_cpu_ms,
  quantile_disc(cpu_frame_ms, 0.999) AS p999_cpu_ms, MAX(cpu_frame_ms) AS max_cpu_ms, SUM(hitch)::DOUBLE AS hitches, MAX(peak_rss_mb)::DOUBLE AS peak_rss_mb, SUM(alloc_count)::DOUBLE AS alloc_count, SUM(bytes_uploaded) / 1048576.0 AS uploaded_mib FROM ({_FRAMES}) GROUP BY arm, rep)"""
_ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in runs.METRICS)


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = views._view(spark, sf_dir, "events", _FRAMES)
    whole = ("arm", "rep", "frame", "hitch", "alloc_count", "bytes_uploaded")
    return frames.select(*[F.col(c).cast("long" if c in whole else "double").alias(c) for c in frames.columns])


def _metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = _frames(spark, sf_dir)
    told = frames.select("arm", "rep").distinct().where("rep <> 2").withColumn("cpu_secs", F.col("arm") * 1.5 + F.col("rep"))
    return runs.run_metrics(frames, told).withColumn("arm", F.col("arm").cast("string"))


def _manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _frames(spark, sf_dir).groupBy("arm", "rep").agg(F.count("*").alias("n"))
    arm, rep = F.col("arm"), F.col("rep")
    return n.select(
        arm.cast("string").alias("arm"), "rep", F.lit("traverse").alias("scenario"), F.lit("8").alias("workers"), F.when((arm == 2) & (rep == 0), "high").otherwise("medium").alias("tier"), F.when(rep != 4, "64").alias("cpus"),
        F.col("n").cast("string").alias("frames"), (arm * 10).cast("string").alias("exe_len"), F.when(rep < 2, "a").otherwise("b").alias("provider"), F.when(~((arm == 1) & (rep == 3)), F.concat(F.lit("h"), (rep % 2).cast("string"))).alias("trace_hash"),
    )


@_query(f"SELECT arm, rep, {_ROUNDED} FROM {_METRICS_SQL}")
def board_run_metrics(spark, sf_dir):
    """The twelve metrics of each run."""
    return _metrics(spark, sf_dir).select("arm", "rep", *[F.round(m, 6).alias(m) for m in runs.METRICS])


@_query(
    "WITH r AS (SELECT * FROM " + _RUNS_SQL + "), "
    + "l AS (" + " UNION ALL ".join(f"SELECT NULL AS arm, '{k}' AS key, COALESCE({k}, '?') AS value FROM r" for k in ("tier", "workers", "scenario", "frames", "cpus")) + " UNION ALL " + " UNION ALL ".join(f"SELECT arm, '{k}', COALESCE({k}, '?') FROM r" for k in ("exe_len", "provider")) + ") "
    + "SELECT arm, key, COUNT(DISTINCT value) AS n_values FROM l GROUP BY arm, key HAVING COUNT(DISTINCT value) > 1"
)
def board_gates(spark, sf_dir):
    """Keys that differ over all runs (thirteen) and within an arm (five); those that no run has are '?' everywhere."""
    return runs.mismatches(_manifests(spark, sf_dir))


@_query(f"SELECT COALESCE(trace_hash, '?') AS trace_hash, string_agg(arm || '#' || lpad(rep::VARCHAR, 2, '0'), ', ' ORDER BY arm || '#' || lpad(rep::VARCHAR, 2, '0')) AS runs FROM {_RUNS_SQL} GROUP BY 1")
def board_work_parity(spark, sf_dir):
    return runs.work_parity(_manifests(spark, sf_dir))


@_query(
    f"WITH m AS (SELECT * FROM {_METRICS_SQL}), l AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, arm, CASE WHEN isfinite({m}) THEN {m} END AS v FROM m" for m in runs.METRICS) + "), "
    + "a AS (SELECT metric, arm, quantile_disc(v, 0.5) AS centre, CASE WHEN MIN(v) > 0 THEN MAX(v) / MIN(v) - 1 END AS spread FROM l GROUP BY metric, arm), "
    + "b AS (SELECT metric, MAX(centre) FILTER (WHERE arm = '0') AS a, MAX(centre) FILTER (WHERE arm = '1') AS b, COALESCE(MAX(spread), 0) AS band, bool_and(COALESCE(centre = 0, false)) AS zero FROM a GROUP BY metric), "
    + "c AS (SELECT *, CASE WHEN b <> 0 THEN a / b - 1 END AS delta FROM b) "
    + "SELECT metric, round(a, 6) AS a, round(b, 6) AS b, round(delta, 6) AS delta, round(band, 6) AS band, CASE WHEN zero THEN 'identical (both zero)' WHEN delta IS NULL THEN 'no data' WHEN abs(delta) <= band THEN 'inside the noise' ELSE 'outside the band' END AS verdict FROM c"
)
def board_deltas(spark, sf_dir):
    """Each metric's difference of two arms against the spread of the arms' own runs."""
    found = runs.deltas(_metrics(spark, sf_dir), "0", "1")
    return found.select("metric", *[F.round(c, 6).alias(c) for c in ("a", "b", "delta", "band")], "verdict")


_LINE = "printf('%d,%.4f,%.6f,%.6f,%.6f,%.6f,%.6f,%.6f,%.6f,%d,%d,%d,%.4f,%d,%d,%.3f,%.3f,%.3f,%.3f,%.3f,%d,%016x,%016x,%d'"


@_query(f"SELECT frame, {_LINE}, frame, sim_time::DOUBLE, cpu_frame_ms, 0.0::DOUBLE, 0.0::DOUBLE, stream_cpu_ms::DOUBLE, parse_ms::DOUBLE, 0.0::DOUBLE, upload_ms::DOUBLE, bytes_uploaded, bytes_uploaded, arm, 0.5::DOUBLE, alloc_count, 0, peak_rss_mb::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 1.5::DOUBLE, 2.0::DOUBLE, rep, frame, frame * 65537, hitch::BIGINT) AS line FROM ({_FRAMES})")
def frame_lines(spark, sf_dir):
    """Frame records as their text lines."""
    zero, one = F.lit(0.0), F.lit(0).cast("long")
    held = {"gpu_frame_ms": zero, "present_ms": zero, "decode_ms": zero, "bytes_read": F.col("bytes_uploaded"), "requests": F.col("arm"), "resident_pct": F.lit(0.5), "alloc_bytes": one, "vram_used_mb": zero, "vram_budget_mb": zero, "pool_used_mb": F.lit(1.5), "pool_budget_mb": F.lit(2.0), "evicted": F.col("rep"), "request_hash": F.col("frame"), "upload_hash": F.col("frame") * 65537}
    frames = _frames(spark, sf_dir).withColumns(held)
    return frames.select("frame", runs.csv_line(frames).alias("line"))


@_query("SELECT rep, (pos - 1)::BIGINT AS position, (CASE WHEN rep % 2 = 1 THEN ['c', 'b', 'a'] ELSE ['a', 'b', 'c'] END)[pos] AS arm FROM (SELECT UNNEST(range(7)) AS rep), (SELECT UNNEST(range(1, 4)) AS pos)")
def abba_schedule(spark, sf_dir):
    return runs.schedule(spark, ["a", "b", "c"], 7)


@_query("""SELECT event_id, split_part(line, ' ', 1) AS key, trim(substr(line, position(' ' IN line) + 1)) AS value FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '# ' || event_type WHEN 1 THEN event_type WHEN 2 THEN event_type || '  ' || user_id || ' x ' ELSE 'seed ' || user_id END AS line FROM events)
WHERE line NOT LIKE '#%' AND position(' ' IN line) > 0""")
def manifest_lines(spark, sf_dir):
    """Manifest text as fields: comments and lines without a value are left out."""
    e = views.table(spark, sf_dir, "events")
    user, kind, k = F.col("user_id").cast("string"), F.col("event_type"), F.col("event_id") % 4
    line = F.when(k == 0, F.concat(F.lit("# "), kind)).when(k == 1, kind).when(k == 2, F.concat(kind, F.lit("  "), user, F.lit(" x "))).otherwise(F.concat(F.lit("seed "), user))
    return runs.manifest_fields(e.select("event_id", line.alias("value")))


@_query(f"""WITH t AS (SELECT * FROM (VALUES {_values([(t[0], t[1], t[2], t[3], t[4], t[6] << 20) for t in scenario.TIERS])}) AS t(tier, size, lambda_, mip_bias, pressure, upload_budget))
SELECT tier, p_partkey AS tex, CASE WHEN tier <> 'medium' AND p_partkey % 16 = 8 THEN 'bc6h' WHEN p_partkey % 4 = 2 THEN 'bc5u' WHEN p_partkey % 4 = 3 THEN 'bc4u' WHEN tier = 'ultra' THEN 'bc7' WHEN tier = 'high' THEN CASE WHEN p_partkey % 8 < 4 THEN 'bc7' ELSE 'bc1' END WHEN p_partkey % 8 < 4 THEN 'bc1' ELSE 'bc3' END AS content,
  size, lambda_::DOUBLE AS lambda, mip_bias::DOUBLE AS mip_bias, pressure::DOUBLE AS pressure, upload_budget FROM part CROSS JOIN t""")
def tier_contents(spark, sf_dir):
    """Every texture's class and settings in each tier."""
    parts = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tex"), F.explode(F.array(*[F.lit(t[0]) for t in scenario.TIERS])).alias("tier"))
    return scenario.contents(parts).join(F.broadcast(scenario.tiers(spark)), "tier").select("tier", "tex", "content", "size", "lambda", "mip_bias", "pressure", "upload_budget")


@_query(f"SELECT name, kind, COUNT(*) AS reported, MIN(f)::BIGINT AS first, round(MAX(f) * 1.0 / 60, 6) AS last_second FROM (SELECT name, kind, warmup, UNNEST(range(frames)) AS f FROM (VALUES {_values([(s[0], s[1], s[2], s[4]) for s in scenario.SCENARIOS])}) AS s(name, kind, frames, warmup)) WHERE f >= warmup GROUP BY name, kind")
def scenario_frames(spark, sf_dir):
    """Frames that each scenario reports, after its warm-up."""
    frames = scenario.scenarios(spark).withColumn("frame", F.explode(F.sequence(F.lit(0).cast("long"), F.col("frames") - 1)))
    return scenario.reported(frames, F.col("warmup")).groupBy("name", "kind").agg(F.count("*").alias("reported"), F.min("frame").alias("first"), F.round(F.max(F.col("frame") * F.col("dt")), 6).alias("last_second"))


_WRAP = "18446744073709551616::UHUGEINT"


def _mix_sql(z: str) -> list[str]:
    """The steps of the generator on 64-bit unsigned numbers, products modulo 2**64."""
    return [f"((xor({z}, {z} >> 30)::UHUGEINT * {scenario.M1}::UHUGEINT) % {_WRAP})::UBIGINT", f"((xor({z}, {z} >> 27)::UHUGEINT * {scenario.M2}::UHUGEINT) % {_WRAP})::UBIGINT", f"xor({z}, {z} >> 31)"]


@_query(f"""WITH k AS (SELECT p_partkey AS tex, UNNEST([0, 1, 2]) AS axis FROM part), a AS (SELECT tex, axis, ((42::UHUGEINT + {scenario.GOLDEN}::UHUGEINT * (3 * tex + axis + 2)::UHUGEINT) % {_WRAP})::UBIGINT AS z FROM k),
b AS (SELECT tex, axis, {_mix_sql("z")[0]} AS z FROM a), c AS (SELECT tex, axis, {_mix_sql("z")[1]} AS z FROM b), d AS (SELECT tex, axis, ({_mix_sql("z")[2]} >> 40)::FLOAT / 16777216::FLOAT AS u FROM c),
e AS (SELECT tex, axis, CASE WHEN axis = 1 THEN (-6)::FLOAT + u * 12::FLOAT ELSE (-300)::FLOAT + u * 600::FLOAT END AS v FROM d)
SELECT tex, MAX(v) FILTER (WHERE axis = 0)::DOUBLE AS x, MAX(v) FILTER (WHERE axis = 1)::DOUBLE AS y, MAX(v) FILTER (WHERE axis = 2)::DOUBLE AS z FROM e GROUP BY tex""")
def world_places(spark, sf_dir):
    """Places of the seeded world, each drawn by itself."""
    return scenario.world(views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("tex")), 42)
