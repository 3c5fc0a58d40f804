"""The residency pool: uploads within a frame's budget, and eviction of what was least recently wanted.

What is resident depends on every frame before, so a run is a state machine: runs are processed
side by side, frames of a run in order, in batch (``replay``) or as a stream (``replay_stream``).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "run_id long, frame long, requests long, uploaded_bytes long, uploads long, evicted long, resident_bytes long, resident_pct double"


@dataclass
class Pool:
    upload_budget: int
    pool_budget: int
    resident: dict[tuple[int, int], int] = field(default_factory=dict)
    wanted_at: dict[int, int] = field(default_factory=dict)

    def step(self, frame: int, wanted: list[tuple[int, int, int]]) -> tuple[int, int, int, int, int, float]:
        """Serve one frame's (tex, mip, bytes).  A level that does not fit in what is left of the budget is passed over."""
        left, new, there = self.upload_budget, [], 0
        for tex, mip, size in sorted(wanted):
            self.wanted_at[tex] = frame
            if (tex, mip) in self.resident:
                there += 1
            elif 0 < left and size <= left:
                left -= size
                new.append((tex, mip, size))
        for tex, mip, size in new:
            self.resident[tex, mip] = size
        total, gone = sum(self.resident.values()), 0
        if total > self.pool_budget:
            # oldest texture first, its finest level first, and nothing of this frame
            for _, tex, mip in sorted((self.wanted_at[t], t, m) for t, m in self.resident if self.wanted_at[t] != frame):
                if total <= self.pool_budget:
                    break
                total -= self.resident.pop((tex, mip))
                gone += 1
        share = (there + len(new)) / len(wanted) if wanted else 1.0
        return len(wanted), self.upload_budget - left, len(new), gone, total, share


def _frames(pool: Pool, run: int, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for frame, own in rows.sort_values(["frame", "tex", "mip"]).groupby("frame"):
        out.append((run, int(frame), *pool.step(int(frame), list(zip(own["tex"], own["mip"], own["bytes"], strict=True)))))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SCHEMA.split(", ")])


def _replay(upload_budget: int, pool_budget: int):
    """Runs one after the other, from rows in the order of run and frame; a frame's rows are held until the next begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pool, now, held = Pool(upload_budget, pool_budget), None, []
        names, kinds = zip(*(c.split() for c in SCHEMA.split(", ")), strict=True)

        def done() -> pa.RecordBatch:
            row = (*now, *pool.step(now[1], [w for part in held for w in part]))
            return pa.RecordBatch.from_arrays([pa.array([v], pa.float64() if k == "double" else pa.int64()) for v, k in zip(row, kinds, strict=True)], list(names))

        for batch in batches:
            runs, frames = (batch.column(n).to_numpy() for n in ("run_id", "frame"))
            cuts = np.flatnonzero((np.diff(runs) != 0) | (np.diff(frames) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                key = int(runs[a]), int(frames[a])
                if key != now:
                    if now is not None:
                        yield done()
                        if key[0] != now[0]:
                            pool = Pool(upload_budget, pool_budget)
                    now, held = key, []
                held.append(list(zip(*(batch.column(n).slice(a, b - a).to_pylist() for n in ("tex", "mip", "bytes")), strict=True)))
        if now is not None:
            yield done()

    return run


def replay(requests: DataFrame, upload_budget: int, pool_budget: int) -> DataFrame:
    """Frame records of each run of ``requests`` (run_id, frame, tex, mip, bytes); a task holds the pool and one frame of a run, not all its requests."""
    rows = requests.select(*[F.col(c).cast("long").alias(c) for c in ("run_id", "frame", "tex", "mip", "bytes")])
    return rows.repartition("run_id").sortWithinPartitions("run_id", "frame").mapInArrow(_replay(upload_budget, pool_budget), SCHEMA)


_STATE = "tex array<long>, mip array<long>, size array<long>, seen_tex array<long>, seen_at array<long>"


def replay_stream(requests: DataFrame, upload_budget: int, pool_budget: int) -> DataFrame:
    """The same over a stream whose batches hold whole frames in order; the pool is the stream's state."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pool = Pool(upload_budget, pool_budget)
        if state.exists:
            tex, mip, size, seen, at = state.get
            pool.resident = dict(zip(zip(tex, mip, strict=True), size, strict=True))
            pool.wanted_at = dict(zip(seen, at, strict=True))
        yield _frames(pool, int(key[0]), pd.concat(list(batches)))
        held = list(pool.resident.items())
        state.update(([k[0] for k, _ in held], [k[1] for k, _ in held], [v for _, v in held], list(pool.wanted_at), list(pool.wanted_at.values())))

    return requests.groupBy("run_id").applyInPandasWithState(run, SCHEMA, _STATE, "append", GroupStateTimeout.NoTimeout)
