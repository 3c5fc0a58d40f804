"""Sharding along a Hilbert curve.

Three metadata dimensions (size, language, source) are quantised to a grid, the latter two by the
rank of their values so that cells keep the values' order, rows are sorted by
their cell's index on the Hilbert curve, and the order is cut into runs whose lengths differ by
one at most.  Neighbours on the curve are neighbours in every dimension, so a shard spans a narrow
range of each and a reader can skip it by its minima and maxima.  Equal texts share one cell (that
of their group's least metadata) and stand together within it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

SHARDS = 40
#: Bits of each dimension.
BITS = 6
#: Values of a dimension that are counted one by one; if there are more, steps of the order with this share of all rows are.
VALUES = 4096


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Index on the Hilbert curve of each row of ``points`` (n, dimensions), values below 2**bits.

    The coordinates become the index's transposed bits by undoing the curve's reflections and
    exchanges from the highest bit down, then by a Gray code.
    """
    x = points.astype(np.int64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for i in range(n):
            flip = (x[i] >> b) & 1 == 1
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        turn = np.where((x[n - 1] >> b) & 1 == 1, turn ^ ((1 << b) - 1), turn)
    x ^= turn
    index = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | ((x[i] >> b) & 1)
    return index


def bounds(counts: list[tuple[str, int]], cells: int) -> list[str]:
    """The first value of each cell but the first: each value its own if they are few, else cells of equal numbers of rows."""
    counts = sorted(counts)
    if len(counts) <= cells:
        return [v for v, _ in counts[1:]]
    cuts, held, left = [], 0, sum(n for _, n in counts)
    for value, n in counts:
        if held * (cells - len(cuts)) >= left and held:
            cuts.append(value)
            left, held = left - held, 0
        held += n
    return cuts


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Values with the rows of those before them in their partition."""
    part, held = TaskContext.get().partitionId(), 0
    for batch in batches:
        total = held + np.cumsum(np.asarray(batch.column("n")))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(total), part, np.int64)), pa.array(total - np.asarray(batch.column("n")))], ["v", "n", "part", "before"])
        held = int(total[-1]) if len(total) else held


def _bounds(rows: DataFrame, name: str, scratch: Scratch) -> list[str]:
    """``bounds`` by all rows; neighbours in the order are counted together where the values are very many."""
    values = rows.groupBy(F.coalesce(name, F.lit("")).alias("v")).agg(F.count("*").alias("n"))
    few = values.limit(VALUES + 1).collect()
    if len(few) > VALUES:
        ordered = scratch.save(values.repartitionByRange("v").sortWithinPartitions("v").mapInArrow(_running, "v string, n long, part long, before long"), f"values_{name}")
        sizes = ordered.groupBy("part").agg(F.sum("n").alias("size"))
        # one row for each partition of the sort, whatever the table's size
        offsets = sizes.select("part", (F.sum("size").over(Window.orderBy("part")) - F.col("size")).alias("first"), F.sum("size").over(Window.partitionBy()).alias("total"))
        step = F.expr(f"cast((first + before) * cast({VALUES} as decimal(38, 0)) div total as long)")
        few = ordered.join(F.broadcast(offsets), "part").groupBy(step.alias("step")).agg(F.min("v").alias("v"), F.sum("n").alias("n")).collect()
    return bounds([(r.v, r.n) for r in few], 1 << BITS)


def _curve(cuts: dict[str, list[str]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [np.asarray(batch.column("q_size"))]
            for name, held in cuts.items():
                points.append(np.array([bisect_right(held, v or "") for v in batch.column(name).to_pylist()], np.int64))
            kept = [c for c in batch.schema.names if c != "q_size" and c not in cuts]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(hilbert(np.stack(points, 1), BITS))], [*kept, "curve"])

    return run


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n))], [*batch.schema.names, "part", "at"])
        at += n


def shard(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, curve of every row of ``documents`` (doc_id, text, lang, source).

    The law is ``rows``: counts are at most one apart.  A null text has no bytes (size 16, checksum
    of nothing); null metadata count as empty; repeated rows get a slot each; other columns are
    ignored; an empty table gives no rows.  With fewer rows than shards some shards are empty.
    """
    scratch = Scratch(documents.sparkSession, "sharding")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("text_hash"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"))
    grid = rows.groupBy("text_hash", "size").agg(F.min("lang").alias("lang"), F.min("source").alias("source"))
    steps = F.least(F.lit((1 << BITS) - 1), F.floor(3 * F.log2(F.col("size") / 16))).cast("long")
    cuts = {name: _bounds(rows, name, scratch) for name in ("lang", "source")}
    cells = grid.select("text_hash", "size", steps.alias("q_size"), *cuts).mapInArrow(_curve(cuts), "text_hash long, size long, curve long")
    placed = rows.drop("lang", "source").join(cells, ["text_hash", "size"])
    ordered = placed.repartitionByRange("curve", "text_hash", "doc_id").sortWithinPartitions("curve", "text_hash", "doc_id")
    numbered = scratch.save(ordered.mapInArrow(_number, ordered._jdf.schema().toDDL() + ", part long, at long"), "ordered")
    sizes = numbered.groupBy("part").agg(F.count("*").alias("n"))
    # one row for each partition of the sort, whatever the table's size
    offsets = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    rank = F.col("before") + F.col("at")
    number = F.expr(f"(before + at) * {shards} div total")
    first = F.expr(f"(shard * total + {shards - 1}) div {shards}")
    return (
        numbered.join(F.broadcast(offsets), "part")
        .withColumn("shard", number)
        .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), (rank - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve")
    )


def write_shards(documents: DataFrame, assigned: DataFrame, path: str) -> None:
    """Parquet files of ``documents`` by shard, each in its order; doc_id must be unique and not null here."""
    joined = documents.join(assigned.select("doc_id", "shard", "slot"), "doc_id")
    joined.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
