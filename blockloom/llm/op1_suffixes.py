"""Exact substring dedup by suffix sorting: bytes of repeated 200-byte strings go.

Sorting all suffixes of a large corpus would move each byte many times over, so the work is first
split, without loss, into independent parts.  Every window of ``length`` bytes has an anchor, the
position of the least hash among its first ``span`` positions, and the ``length - span + 1`` bytes
behind the anchor, its core, lie inside the window.  Equal windows have equal cores at equal
offsets.  A core that occurs once has no repeated window; one whose occurrences all stand in the
same context (the bytes of all windows anchored there) has only repeated ones.  What remains are
cores in different contexts, at the edges of repeats: these contexts are sorted by a difference
cover suffix sort (triples sampled, named, recursed on, the rest merged), block by block with
equal cores together, and prefixes of adjacent suffixes are compared for ``length`` equal bytes.
Very many different contexts of one core are divided by longer cores that their windows share.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .suffix import suffix_array
from .textkernel import Buffer, mix, pieces, span_hashes

LENGTH, SPAN = 200, 100
_GRAM = 16
#: Different contexts of one core beyond which they are divided by longer cores.
CROWD = 2000
#: Windows start within so many positions of each other in a divided part.
_STEP = 4
#: Bytes sorted at once (more only where one core's contexts have more).
BLOCK_BYTES = 1 << 19


def anchors(buffer: Buffer, length: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of each maximal run of windows with one anchor."""
    n = len(buffer)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none
    prefix = buffer.prefix()
    m = n - _GRAM + 1
    at = np.arange(m)
    value = (span_hashes(prefix, at, at + _GRAM) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    pad = -m % span
    rows = np.concatenate([value, np.full(pad, ~np.uint64(0))]).reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    p = np.arange(n - length + 1)
    anchor = (np.minimum(behind[p], ahead[p + span - 1]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    end = np.zeros(n, np.int64)
    full = buffer.ends > buffer.starts
    end[buffer.starts[full]] = buffer.ends[full]
    p = p[p + length <= np.maximum.accumulate(end)[p]]
    if not len(p):
        return none, none, none
    new = np.ones(len(p), bool)
    new[1:] = (anchor[p][1:] != anchor[p][:-1]) | (p[1:] != p[:-1] + 1)
    first = np.flatnonzero(new)
    return anchor[p[first]], p[first], p[np.append(first[1:] - 1, len(p) - 1)]


def _hashed(buffer: Buffer, length: int, span: int) -> tuple[np.ndarray, ...]:
    """Core hash, context hash, anchor, first start, last start of each run."""
    at, first, last = anchors(buffer, length, span)
    prefix = buffer.prefix()
    core = span_hashes(prefix, at, at + length - span + 1)
    context = mix(span_hashes(prefix, first, last + length) + (at - first).astype(np.uint64))
    return core.view(np.int64), context.view(np.int64), at, first, last


def _cores(length: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            core, context, *_ = _hashed(Buffer(part.column("text")), length, span)
            yield pa.RecordBatch.from_arrays([pa.array(core), pa.array(context)], ["core", "context"])

    return run


def _places(length: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            buffer = Buffer(part.column("text"))
            core, context, at, first, last = _hashed(buffer, length, span)
            doc = buffer.document_of(first) if len(first) else first
            begin = buffer.starts[doc] if len(first) else first
            rows = [pa.array(core), pa.array(context), *(part.column(c).take(pa.array(doc)) for c in ("doc_id", "text_hash")), pa.array(first - begin), pa.array(last - begin + 1), pa.array(at - first)]
            yield pa.RecordBatch.from_arrays(rows, ["core", "context", "doc_id", "text_hash", "first", "stop", "offset"])

    return run


def _strings(length: int, span: int):
    """The bytes of the listed contexts; those of crowded cores in parts, by the bytes that a part's windows share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, text_hash, text, wanted in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), batch.column("bytes").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                for w in wanted:
                    a, stop = w["first"], w["stop"]
                    if not w["crowded"]:
                        out.append((w["core"], doc, text_hash, a, w["single"], text[a : stop - 1 + length]))
                        continue
                    # parts by the window's distance to the context's anchor, which equal windows share
                    anchor = a + w["offset"]
                    for p in range(anchor - (anchor - a) // _STEP * _STEP, stop + _STEP, _STEP):
                        x, y = max(a, p - _STEP + 1), min(stop, p + 1)
                        if x < y:
                            shared = text[p : p - _STEP + 1 + length]
                            key = int.from_bytes(hashlib.blake2b(shared + bytes([(anchor - p) % 251]), digest_size=8).digest(), "little", signed=True)
                            out.append((key, doc, text_hash, x, w["single"], text[x : y - 1 + length]))
                if len(out) > 4000:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return run


_STRINGS = pa.schema([("part", pa.int64()), ("doc_id", pa.int64()), ("text_hash", pa.int64()), ("first", pa.int64()), ("single", pa.bool_()), ("bytes", pa.binary())])


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*out, strict=True), _STRINGS, strict=True)], schema=_STRINGS)


def repeated_starts(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string the positions whose ``length`` bytes start elsewhere in these strings too."""
    sizes = np.array([len(x) for x in strings])
    begin = np.cumsum(sizes + 1) - sizes - 1
    joined = np.frombuffer(b"\0".join(strings), np.uint8).astype(np.int64) + 2
    ends = begin + sizes
    joined[ends[:-1]] = 1
    order = suffix_array(joined)
    owner = np.repeat(np.arange(len(strings)), sizes + 1)[: len(joined)]
    order = order[order + length <= ends[owner[order]]]
    # windows end before a separator, so that bytes are enough; most unlike neighbours differ in the last one or the middle
    small = (joined - 2).astype(np.uint8)
    same = np.zeros(max(0, len(order) - 1), bool)
    likely = np.arange(len(same))
    for at in (length - 1, length // 2):
        likely = likely[small[order[likely] + at] == small[order[likely + 1] + at]]
    wide = np.lib.stride_tricks.sliding_window_view(small, length) if len(small) >= length else small[:0].reshape(0, length)
    for a in range(0, len(likely), 1 << 13):
        some = likely[a : a + (1 << 13)]
        same[some] = (wide[order[some]] == wide[order[some + 1]]).all(axis=1)
    hit = np.zeros(len(joined), bool)
    hit[order[:-1][same]] = True
    hit[order[1:][same]] = True
    return [np.flatnonzero(hit[a:b]) for a, b in zip(begin, ends, strict=True)]


_FOUND = "doc_id long, text_hash long, first long, stop long"


def _sort(length: int):
    def block(rows: list[tuple]) -> Iterator[tuple]:
        for (_, doc, text_hash, first, single, _), starts in zip(rows, repeated_starts([r[5] for r in rows], length), strict=True):
            if single and len(starts):
                cut = np.flatnonzero(np.diff(starts) > 1)
                for a, b in zip(starts[np.append(0, cut + 1)], starts[np.append(cut, len(starts) - 1)], strict=True):
                    yield doc, text_hash, first + int(a), first + int(b) + length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            out: list[tuple] = []
            for row in zip(*(batch.column(c).to_pylist() for c in _STRINGS.names), strict=True):
                if size >= BLOCK_BYTES and held[-1][0] != row[0]:
                    out += block(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[5])
            yield _found(out)
        if held:
            yield _found(list(block(held)))

    return run


def _found(out: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*out, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], ["doc_id", "text_hash", "first", "stop"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept, sizes, removed, spans = [], [], [], []
        for text, cuts in zip(batch.column("bytes").to_pylist(), batch.column("cuts").to_pylist(), strict=True):
            runs: list[list[int]] = []
            for c in sorted((c["first"], c["stop"]) for c in cuts or []):
                if runs and c[0] <= runs[-1][1]:
                    runs[-1][1] = max(runs[-1][1], c[1])
                else:
                    runs.append(list(c))
            edges = [0, *(x for r in runs for x in r), len(text)]
            kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
            sizes.append(len(text))
            removed.append(len(text) - len(kept[-1]))
            spans.append([{"first": a, "stop": b} for a, b in runs])
        kind = pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "spans", "kept"])


def remove_repeats(documents: DataFrame, length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (first, stop) and the kept bytes of each row of ``documents`` (doc_id, text).

    A byte goes when some string of ``length`` bytes that covers it starts anywhere else too, in
    this row or another; strings do not cross rows.  A null text is empty; a text shorter than
    ``length`` stays whole.  Rows that repeat doc_id and text are copies of each other and lose
    every byte that any such string covers.
    """
    scratch = Scratch(documents.sparkSession, "suffixes")
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    cores = docs.select("text").mapInArrow(_cores(length, span), "core long, context long").groupBy("core").agg(F.count("*").alias("n"), F.min("context").alias("low"), F.max("context").alias("high")).where("n > 1")
    cores = scratch.save(cores.select("core", (F.col("low") != F.col("high")).alias("mixed")), "cores")
    places = docs.mapInArrow(_places(length, span), "core long, context long, doc_id long, text_hash long, first long, stop long, offset long")
    places = scratch.save(places.join(cores, "core"), "places")
    stop = (F.col("stop") + (length - 1)).alias("stop")
    whole = places.where("not mixed").select("doc_id", "text_hash", "first", stop)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash", "first", "stop", "offset"))
    contexts = scratch.save(places.where("mixed").groupBy("core", "context").agg(F.count("*").alias("n"), one.alias("p")), "contexts")
    again = places.where("mixed").join(contexts.where("n > 1").select("core", "context"), ["core", "context"], "left_semi").select("doc_id", "text_hash", "first", stop)
    crowds = contexts.groupBy("core").agg((F.count("*") > CROWD).alias("crowded"))
    wanted = contexts.join(crowds, "core").select("core", "p.*", (F.col("n") == 1).alias("single"), "crowded")
    return _finish(docs, wanted, whole.union(again), scratch, length, span)


def _finish(docs: DataFrame, wanted: DataFrame, sure: DataFrame, scratch: Scratch, length: int, span: int) -> DataFrame:
    """Sort the wanted contexts, add what is sure, and cut."""
    item = F.struct("core", "first", "stop", "single", "crowded", "offset")
    lists = wanted.groupBy(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash")).agg(F.collect_list(item).alias("wanted"))
    # a row that repeats doc_id and text holds the same bytes, so that one of them will do
    held = docs.join(lists, F.expr("doc_id <=> w_id and text_hash = w_hash")).select("doc_id", "text_hash", F.col("text").cast("binary").alias("bytes"), "wanted").dropDuplicates(["doc_id", "text_hash"])
    ddl = "part long, doc_id long, text_hash long, first long, single boolean, bytes binary"
    strings = held.mapInArrow(_strings(length, span), ddl)
    sorted_ = strings.repartition("part").sortWithinPartitions("part")
    edges = scratch.save(sorted_.mapInArrow(_sort(length), _FOUND), "edges")
    cuts = sure.union(edges).groupBy(F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash")).agg(F.collect_list(F.struct("first", "stop")).alias("cuts"))
    cuts = scratch.save(cuts, "cuts")
    scratch.drop("cores", "places", "contexts", "edges")
    rows = docs.join(cuts, F.expr("doc_id <=> c_id and text_hash = c_hash"), "left").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("bytes"), "cuts")
    return rows.mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, spans array<struct<first: bigint, stop: bigint>>, kept binary")


def digest(kept: DataFrame) -> DataFrame:
    """The query's columns, from ``remove_repeats``."""
    return kept.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
