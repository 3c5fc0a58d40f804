"""Benchmark runs as tables: frame records and manifests to and from text, run metrics, gates and the board."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import board

# The columns of a frame record's line, and how each is written.
FRAME_FORMATS = {
    "frame": "%d", "sim_time": "%.4f", "cpu_frame_ms": "%.6f", "gpu_frame_ms": "%.6f", "present_ms": "%.6f", "stream_cpu_ms": "%.6f", "parse_ms": "%.6f", "decode_ms": "%.6f", "upload_ms": "%.6f", "bytes_read": "%d", "bytes_uploaded": "%d", "requests": "%d", "resident_pct": "%.4f",
    "alloc_count": "%d", "alloc_bytes": "%d", "peak_rss_mb": "%.3f", "vram_used_mb": "%.3f", "vram_budget_mb": "%.3f", "pool_used_mb": "%.3f", "pool_budget_mb": "%.3f", "evicted": "%d", "request_hash": "%016x", "upload_hash": "%016x", "hitch": "%d",
}
# Manifest keys that all runs, and those that the runs of one arm, must share.
PINNED = ("pack_hash", "tier", "workers", "scenario", "frames", "os", "cpus", "alloc_counters", "seed", "pool_budget", "pinned", "pool_mult", "pool_buffers")
PINNED_ARM = ("exe_len", "exe_mtime", "allocator", "provider", "peer")
# A run's metrics.
METRICS = ("cpu_secs", "stream_ms_total", "parse_ms_total", "upload_ms_total", "median_cpu_ms", "p99_cpu_ms", "p999_cpu_ms", "max_cpu_ms", "hitches", "peak_rss_mb", "alloc_count", "uploaded_mib")
#: Fixed value: a frame of more ms is a hitch.
HITCH_MS = 1.0


def hitch(cpu_ms: Column) -> Column:
    return F.when(cpu_ms > HITCH_MS, F.lit(1)).otherwise(F.lit(0)).cast("long")


def csv_line(frames: DataFrame) -> Column:
    """A record's line, its columns in the fixed order and form, halves to even; hashes are signed 64-bit numbers here."""
    held = [F.bround(c, int(f[2])) if f.endswith("f") else F.col(c) for c, f in FRAME_FORMATS.items()]
    return F.format_string(",".join(FRAME_FORMATS.values()), *held)


def manifest_fields(lines: DataFrame, value: str = "value") -> DataFrame:
    """Key and value of each manifest line: cut at the first space; comments and lines without a value go."""
    some = lines.where(~F.col(value).startswith("#") & (F.instr(value, " ") > 0))
    return some.withColumns({"key": F.substring_index(value, " ", 1), "held": F.trim(F.expr(f"substring({value}, instr({value}, ' ') + 1)"))}).drop(value).withColumnRenamed("held", "value")


def write_runs(frames: DataFrame, manifests: DataFrame, path: str) -> None:
    """``frames`` (run_id and a record's columns) as text by run, in frame order, and ``manifests`` (run_id, key, value) beside them."""
    lines = frames.repartition("run_id").sortWithinPartitions("run_id", "frame").select("run_id", csv_line(frames).alias("line"))
    lines.write.partitionBy("run_id").mode("overwrite").text(f"{path}/frames")
    manifests.repartition("run_id").select("run_id", F.concat_ws(" ", "key", "value").alias("line")).write.partitionBy("run_id").mode("overwrite").text(f"{path}/manifests")


def load_runs(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The frames and manifest fields of ``write_runs``, and the runs that are rejected for want of a manifest."""
    ddl = ", ".join(f"{c} {'string' if f == '%016x' else 'long' if f == '%d' else 'double'}" for c, f in FRAME_FORMATS.items())
    frames = spark.read.schema(f"{ddl}, run_id string").csv(f"{path}/frames")
    fields = manifest_fields(spark.read.schema("value string, run_id string").text(f"{path}/manifests"))
    known = fields.select("run_id").distinct()
    rejected = frames.select("run_id").distinct().join(known, "run_id", "left_anti")
    return frames.join(known, "run_id", "left_semi"), fields, rejected


def percentiles(values: DataFrame, by: list[str], value: str, ps: dict[str, float]) -> DataFrame:
    """``by`` and the elements at rank ceil(p * n) of each group.

    Values are counted by bucket first; only the buckets that hold a wanted rank are looked into,
    by distinct value, so that no task gathers a group.
    """
    place = F.when(F.isnan(value), F.lit(board.BUCKETS)).otherwise(board.bucket(F.col(value)))
    counts = values.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n")).withColumn("bucket", place)
    sizes = counts.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    order = Window.partitionBy(*by).orderBy("bucket")
    known = sizes.withColumns({"after": F.sum("n").over(order), "total": F.sum("n").over(Window.partitionBy(*by))})
    wanted = known.withColumn("p", F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(p).alias("p")) for k, p in ps.items()])))
    wanted = wanted.withColumn("rank", F.greatest(F.ceil(F.col("p.p") * F.col("total")), F.lit(1))).where((F.col("rank") <= F.col("after")) & (F.col("rank") > F.col("after") - F.col("n")))
    wanted = wanted.select(*by, "bucket", F.col("p.name").alias("name"), (F.col("rank") - F.col("after") + F.col("n")).alias("rank"))
    inside = counts.join(wanted, [*by, "bucket"])
    upto = F.sum("n").over(Window.partitionBy(*by, "name").orderBy(value))
    found = inside.withColumn("upto", upto).where((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("name") == k, F.col(value))).alias(k) for k in ps])


def run_metrics(frames: DataFrame, cpu_secs: DataFrame, by: tuple[str, ...] = ("arm", "rep")) -> DataFrame:
    """The metrics of each run of ``frames``; ``cpu_secs`` (by, cpu_secs) is what the manifests say, NaN without."""
    sums = frames.groupBy(*by).agg(
        F.sum("stream_cpu_ms").alias("stream_ms_total"), F.sum("parse_ms").alias("parse_ms_total"), F.sum("upload_ms").alias("upload_ms_total"), F.max("cpu_frame_ms").alias("max_cpu_ms"), F.sum("hitch").cast("double").alias("hitches"),
        F.max("peak_rss_mb").alias("peak_rss_mb"), F.sum("alloc_count").cast("double").alias("alloc_count"), (F.sum("bytes_uploaded") / (1 << 20)).alias("uploaded_mib"),
    )
    ranks = percentiles(frames, list(by), "cpu_frame_ms", {"median_cpu_ms": 0.5, "p99_cpu_ms": 0.99, "p999_cpu_ms": 0.999})
    return sums.join(ranks, list(by)).join(cpu_secs, list(by), "left").withColumn("cpu_secs", F.coalesce("cpu_secs", F.lit(float("nan")))).select(*by, *METRICS)


def _long(runs: DataFrame, keys: tuple[str, ...], *held: str) -> DataFrame:
    value = lambda k: F.coalesce(F.col(k).cast("string"), F.lit("?")) if k in runs.columns else F.lit("?")
    return runs.select(*held, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), value(k).alias("value")) for k in keys])).alias("e")).select(*held, "e.*")


def mismatches(runs: DataFrame) -> DataFrame:
    """arm (null: over all runs), key, n_values of each pinned key that differs where it must not; a missing one counts as '?'."""
    over_all = _long(runs, PINNED).groupBy("key").agg(F.count_distinct("value").alias("n_values")).select(F.lit(None).cast("string").alias("arm"), "key", "n_values")
    by_arm = _long(runs, PINNED_ARM, "arm").groupBy("arm", "key").agg(F.count_distinct("value").alias("n_values"))
    return over_all.unionByName(by_arm.withColumn("arm", F.col("arm").cast("string"))).where("n_values > 1")


def work_parity(runs: DataFrame) -> DataFrame:
    """The runs of each trace hash; more than one row means different work."""
    label = F.format_string("%s#%02d", F.col("arm").cast("string"), F.col("rep"))
    return runs.groupBy(F.coalesce("trace_hash", F.lit("?")).alias("trace_hash")).agg(F.concat_ws(", ", F.array_sort(F.collect_list(label))).alias("runs"))


def deltas(metrics: DataFrame, first: str, second: str) -> DataFrame:
    """metric, both arms' centres, delta, band and verdict: medians (nearest rank) against the largest spread of any arm's own runs."""
    finite = F.when(~F.isnan("value") & (F.abs("value") != float("inf")), F.col("value"))
    names = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in METRICS]))
    rows = metrics.select(F.col("arm").cast("string").alias("arm"), names.alias("e")).select("arm", "e.*").withColumn("value", finite)
    arms = rows.groupBy("metric", "arm").agg(board.nearest_rank("value", 0.5).alias("centre"), board.spread("value").alias("spread"))
    of = lambda arm: F.max(F.when(F.col("arm") == arm, F.col("centre")))
    both = arms.groupBy("metric").agg(of(first).alias("a"), of(second).alias("b"), F.coalesce(F.max("spread"), F.lit(0.0)).alias("band"), F.every(F.coalesce(F.col("centre") == 0, F.lit(False))).alias("zero"))
    delta = F.when(F.col("b") != 0, F.col("a") / F.col("b") - 1)
    verdict = F.when(F.col("zero"), "identical (both zero)").when(F.col("delta").isNull(), "no data").when(F.abs("delta") <= F.col("band"), "inside the noise").otherwise("outside the band")
    return both.withColumn("delta", delta).select("metric", "a", "b", "delta", "band", verdict.alias("verdict"))


def schedule(spark: SparkSession, arms: list[str], reps: int) -> DataFrame:
    """rep, position, arm: in order on even reps, reversed on odd ones, so that drift meets all arms alike."""
    listed = F.array(*[F.lit(a) for a in arms])
    rows = spark.range(reps).select(F.col("id").alias("rep"), F.posexplode(F.when(F.col("id") % 2 == 1, F.reverse(listed)).otherwise(listed)).alias("position", "arm"))
    return rows.withColumn("position", F.col("position").cast("long"))


def shown(value: float | None, unit: str = "") -> str:
    """A number as the board writes it: one, three or four decimals by size."""
    if value is None or math.isnan(value):
        return "—"
    text = f"{value:.{1 if abs(value) >= 100 else 3 if abs(value) >= 1 else 4}f}"
    return f"{text} {unit}" if unit else text


def markdown(runs: DataFrame, metrics: DataFrame, first: str, second: str) -> str:
    """The board of two arms as text; what is collected has a row a gate, a trace or a metric."""
    bad, traces = sorted(mismatches(runs).collect(), key=str), work_parity(runs).orderBy("trace_hash").collect()
    out = ["## Gates", ""]
    out += ["- Comparability: PASS"] if not bad else ["- Comparability: REJECT", *[f"  - {r.key} has {r.n_values} values" + (f" within arm {r.arm}" if r.arm else "") for r in bad]]
    out += [f"- Work parity: PASS ({traces[0].trace_hash})"] if len(traces) == 1 else ["- Work parity: REJECT", *[f"  - {r.trace_hash}: {r.runs}" for r in traces]]
    out += ["", "## Metrics", "", f"| metric | {first} | {second} | delta | band | verdict |", "| --- | ---: | ---: | ---: | ---: | --- |"]
    rows = {r.metric: r for r in deltas(metrics, first, second).collect()}
    share = lambda x, sign="": "—" if x is None else f"{100 * x:{sign}.2f}%"
    out += [f"| {m} | {shown(rows[m].a)} | {shown(rows[m].b)} | {share(rows[m].delta, '+')} | ±{share(rows[m].band)} | {rows[m].verdict} |" for m in METRICS if m in rows]
    return "\n".join(out) + "\n"
