"""The pool query replays all requests in each run."""

from pyspark.sql import functions as F

from blockloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def test_each_run_has_all_requests(spark):
    asked = catalog._requests(spark, DATA).count()
    got = catalog.lru_pool(spark, DATA).groupBy("run_id").agg(F.sum("requests").alias("n")).collect()
    assert {r.run_id: r.n for r in got} == {i: asked for i in range(4)}


def test_a_run_is_read_frame_by_frame():
    """The first frames are told before the last requests are read, and a frame may go over batches."""
    import pyarrow as pa

    from blockloom.streaming.pool import Pool, _replay

    rows = [(r, f, t, 0, 100 + t) for r in range(2) for f in range(50) for t in range(f % 7, f % 7 + 9)]
    names = ["run_id", "frame", "tex", "mip", "bytes"]
    read = []

    def batches():
        for a in range(0, len(rows), 7):
            read.append(a)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[a : a + 7])], names)

    got = _replay(600, 1500)(batches())
    first = next(got).to_pylist()
    assert len(read) <= 3
    told = [tuple(r.values()) for r in first] + [tuple(r.values()) for b in got for r in b.to_pylist()]
    want = []
    for r in range(2):
        pool = Pool(600, 1500)
        want += [(r, f, *pool.step(f, [x[2:] for x in rows if x[:2] == (r, f)])) for f in range(50)]
    assert told == want
