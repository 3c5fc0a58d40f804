"""Analytics over frame records: nearest-rank percentiles, spreads, gates, sign test, log histogram."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Buckets of the logarithmic histogram and its range in ms.
BUCKETS, LOW_MS, HIGH_MS = 600, 1e-6, 1e3


def nearest_rank(value: str, p: float) -> Column:
    """The element at rank ceil(p * n); Spark's discrete percentile is that element."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def spread(value: str) -> Column:
    """max / min - 1; none where the least is not positive."""
    return F.when(F.min(value) > 0, F.max(value) / F.min(value) - 1)


def bucket(value: Column) -> Column:
    """Bucket of the histogram: 0 up to the lowest value and for NaN, the last one beyond the highest."""
    t = F.ln(value / LOW_MS) / math.log(HIGH_MS / LOW_MS)
    return F.when((value <= LOW_MS) | F.isnan(value), F.lit(0).cast("long")).otherwise(F.least(F.floor(t * BUCKETS), F.lit(BUCKETS - 1)).cast("long"))


def bucket_value(i: Column) -> Column:
    return F.lit(LOW_MS) * F.exp((i + 0.5) / BUCKETS * math.log(HIGH_MS / LOW_MS))


def histogram(values: DataFrame, by: str, value: str) -> DataFrame:
    """Counts by bucket: partial counts merge, so the sketch is as large as its buckets whatever the input."""
    return values.groupBy(by, bucket(F.col(value)).alias("bucket")).agg(F.count("*").alias("n"))


def sign_z(wins: Column, losses: Column) -> Column:
    """z of the sign test without ties."""
    n = wins + losses
    return F.when(n > 0, (wins - n / 2.0) / F.sqrt(n / 4.0))


def disagreeing(runs: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that have more than one value over all runs, and how many."""
    wide = runs.select(F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("string").alias("value")) for k in keys])).alias("e")).select("e.*")
    return wide.groupBy("key").agg(F.count_distinct("value").alias("n_values")).where("n_values > 1")


def verdict(delta: Column, band: Column) -> Column:
    """Whether a difference is outside the band of the runs' own spread."""
    return F.when(F.abs(delta) <= band, F.lit("inside the band")).when(delta > 0, F.lit("slower")).otherwise(F.lit("faster"))


def gate(ratio_db: Column, band: float = 0.25) -> Column:
    """Quality verdict: a tie within the band."""
    return F.when(ratio_db > band, F.lit("higher")).when(ratio_db < -band, F.lit("lower")).otherwise(F.lit("tie"))
