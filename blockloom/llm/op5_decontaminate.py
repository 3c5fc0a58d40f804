"""Benchmark decontamination by SimHash of item-sized windows.

Every benchmark item and every window of a document as long as an item gets a 64-bit SimHash of
its word shingles.  Four indexes, one for each 16-bit block, hold all values within three bits of
an item's block: by the pigeonhole principle two fingerprints at most 15 bits apart agree in some
block up to three bits, so the indexes return all items within the radius.  The exact similarity
of the weighted shingle sets (weight: number of occurrences) decides.

Windows start at each shingle for items of up to 16 shingles, at each second one up to 32, and so
on, and their length is rounded to the same step; the last window ends with the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import FOLDED_VALUES, Buffer, document_shingles, pieces, span_hashes, tidy

RADIUS = 15
BLOCKS = 4
#: Benchmark items handled in one pass over the documents (what a worker holds: about 30 kB each); more take more passes.
ITEMS_AT_ONCE = 4000
#: Shingles whose bit sums are held at once.
SEGMENT = 1 << 15
_NEAR = np.array([sum(1 << b for b in bits) for k in range(RADIUS // BLOCKS + 1) for bits in combinations(range(16), k)], np.uint16)


def read_shingles(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    buffer = Buffer(texts)
    starts, ends = buffer.words()
    return document_shingles(span_hashes(buffer.prefix(FOLDED_VALUES), starts, ends), buffer.split(starts), n)


def _bit_sums(shingles: np.ndarray, longest: int) -> np.ndarray:
    """Prefix sums of each of the 64 bits, modulo a power of two over ``longest``, which tells all of such a stretch."""
    kind = np.uint8 if longest < 1 << 8 else np.uint16 if longest < 1 << 16 else np.uint32
    bits = np.unpackbits(shingles.view(np.uint8).reshape(-1, 8), axis=1)
    total = np.zeros((len(shingles) + 1, 64), kind)
    np.cumsum(bits, axis=0, dtype=kind, out=total[1:])
    return total


def _fingerprints(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A bit is set where more than half of the shingles from start to end have it."""
    out = np.empty(len(starts), np.uint64)
    for a in range(0, len(starts), 1 << 13):
        first, after = starts[a : a + (1 << 13)], ends[a : a + (1 << 13)]
        ones = np.take(total, after, axis=0)
        ones -= np.take(total, first, axis=0)
        half = ((after - first) // 2).astype(ones.dtype)
        out[a : a + (1 << 13)] = np.packbits(ones > half[:, None]).view(np.uint64)
    return out


def _step(n: int) -> int:
    step = 1
    while n > 16 * step:
        step *= 2
    return step


@dataclass
class Index:
    """The items whose windows have one length: fingerprints, and for each block value the items near it."""

    length: int
    step: int
    items: np.ndarray
    prints: np.ndarray
    first: list[np.ndarray]
    present: list[np.ndarray]
    held: list[np.ndarray]

    @classmethod
    def of(cls, length: int, step: int, items: list[int], prints: np.ndarray) -> Index:
        first, present, held = [], [], []
        for block in prints.view(np.uint16).reshape(-1, BLOCKS).T:
            near = (block[:, None] ^ _NEAR[None]).ravel()
            order = np.argsort(near, kind="stable")
            size = np.bincount(near, minlength=1 << 16)
            first.append(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
            present.append(size > 0)
            held.append((order // len(_NEAR)).astype(np.int32))
        return cls(length, step, np.array(items), prints, first, present, held)

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window, item) within the radius."""
        windows, items = [], []
        for k, block in enumerate(np.ascontiguousarray(prints.view(np.uint16).reshape(-1, BLOCKS).T)):
            # most blocks are near none: a table of one byte a value tells them
            some = np.flatnonzero(np.take(self.present[k], block))
            own = block[some].astype(np.int32)
            low = self.first[k][own]
            n = self.first[k][own + 1] - low
            at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            window, item = np.repeat(some, n), self.held[k][at]
            close = np.bitwise_count(prints[window] ^ self.prints[item]) <= RADIUS
            windows.append(window[close])
            items.append(item[close])
        pair = np.unique(np.concatenate(windows) * len(self.items) + np.concatenate(items))
        return pair // len(self.items), pair % len(self.items)


@dataclass
class Item:
    """A benchmark item: its id, number of shingles, and distinct ones with their numbers."""

    item_id: int | None
    length: int
    values: np.ndarray
    weights: np.ndarray

    def similarity(self, own: np.ndarray) -> tuple[float, int, int]:
        """The best weighted Jaccard similarity to a stretch of ``own`` as long as the item, cut to its outermost common shingles."""
        at = np.searchsorted(self.values, own)
        at[at == len(self.values)] = 0
        there = np.flatnonzero(self.values[at] == own)
        if not len(there):
            return 0.0, 0, 0
        # a shingle counts in the stretches that start behind its weight-th occurrence before
        kind = at[there]
        by = np.argsort(kind, kind="stable")
        back = np.arange(len(by)) - self.weights[kind[by]]
        before = np.full(len(by), -1)
        same = (back >= 0) & (kind[by[np.maximum(back, 0)]] == kind[by])
        before[by[same]] = there[by[back[same]]]
        change = np.zeros(len(own) + 1, np.int64)
        np.add.at(change, np.maximum(np.maximum(before + 1, there - self.length + 1), 0), 1)
        np.add.at(change, there + 1, -1)
        start = np.arange(max(1, len(own) - self.length + 1))
        shared = np.cumsum(change)[: len(start)]
        first = there[np.minimum(np.searchsorted(there, start), len(there) - 1)]
        last = there[np.maximum(np.searchsorted(there, start + self.length) - 1, 0)]
        alike = np.where(shared > 0, shared / np.maximum(self.length + last - first + 1 - shared, 1), 0.0)
        best = int(np.argmax(alike))
        return float(alike[best]), int(first[best]), int(last[best]) + 1


def _windows(begin: np.ndarray, end: np.ndarray, index: Index, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """Document and start of each window of the index that starts from ``low`` to before ``high``, the last ones of the documents included."""
    count = end - begin
    slots = np.where(count > 0, np.maximum(count - index.length, 0) // index.step + 1, 0)
    first = np.clip(-(-(low - begin) // index.step), 0, slots)
    after = np.clip(-(-(high - begin) // index.step), 0, slots)
    size = after - first
    doc = np.repeat(np.arange(len(count)), size)
    start = begin[doc] + (np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + first[doc]) * index.step
    last = np.maximum(begin, end - index.length)
    some = np.flatnonzero((count > 0) & (last >= low) & (last < high))
    return np.concatenate([doc, some]), np.concatenate([start, last[some]])


def _indexes(items: list[Item], prints: np.ndarray) -> list[Index]:
    by: dict[tuple[int, int], list[int]] = {}
    for i, own in enumerate(items):
        step = _step(own.length)
        by.setdefault((step * round(own.length / step), step), []).append(i)
    return [Index.of(length, step, held, prints[held]) for (length, step), held in sorted(by.items())]


def _regions(near: list[np.ndarray]) -> Iterator[tuple[int, int, int, int]]:
    """Document, item, and bounds of the joined overlapping stretches of each."""
    rows = np.unique(np.concatenate(near), axis=0) if near else np.zeros((0, 4), np.int64)
    held: list[int] = []
    for d, k, a, b in rows.tolist():
        if held and held[:2] == [d, k] and a <= held[3]:
            held[3] = max(held[3], b)
        else:
            if held:
                yield tuple(held)
            held = [d, k, a, b]
    if held:
        yield tuple(held)


def _found(texts: pa.Array, indexes: list[Index], items: list[Item], n: int, least: float) -> list[list[dict]]:
    """The hits of each text."""
    shingles, at = read_shingles(texts, n)
    begin, end = at[:-1], at[1:]
    length = np.array([x.length for x in items], np.int64)
    longest = max((x.length for x in indexes), default=1)
    near = []
    for low in range(0, len(shingles), SEGMENT):
        total = _bit_sums(shingles[low : low + SEGMENT + longest], longest)
        for index in indexes:
            doc, start = _windows(begin, end, index, low, low + SEGMENT)
            stop = np.minimum(start + index.length, end[doc])
            window, item = index.near(_fingerprints(total, start - low, stop - low))
            k, d = index.items[item], doc[window]
            near.append(np.stack([d, k, np.maximum(begin[d], start[window] - length[k] // 2), np.minimum(end[d], stop[window] + length[k] // 2)], 1))
    best: list[dict[int, tuple[float, int, int]]] = [{} for _ in range(len(texts))]
    for d, k, a, b in _regions(near):
        same, first, last = items[k].similarity(shingles[a:b])
        if same >= least and same > best[d].get(k, (0.0,))[0]:
            best[d][k] = (same, a - int(begin[d]) + first, a - int(begin[d]) + last + n - 1)
    return [[{"item_id": items[k].item_id, "similarity": x[0], "first_word": x[1], "end_word": x[2]} for k, x in sorted(b.items())] for b in best]


_KIND = pa.list_(pa.struct([("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("end_word", pa.int64())]))


def _scan(items: list[Item], prints: np.ndarray, n: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = _indexes(items, prints)
        for part in pieces(batches, limit=1 << 20):
            hits = _found(part.column("text"), indexes, items, n, least)
            hits = [a + b for a, b in zip(part.column("hits").to_pylist(), hits, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), pa.array(hits, _KIND)], ["doc_id", "text", "hits"])

    return tidy(run)


def _clean(items: list[Item], prints: np.ndarray, n: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = _indexes(items, prints)
        for part in pieces(batches, limit=1 << 20):
            yield part.filter(pa.array([not x for x in _found(part.column("text").cast(pa.string()), indexes, items, n, least)], pa.bool_()))

    return tidy(run)


HITS = "array<struct<item_id: bigint, similarity: double, first_word: bigint, end_word: bigint>>"


def read_items(rows: list, n: int) -> tuple[list[Item], np.ndarray]:
    """Items and fingerprints of benchmark rows (item_id, text); those without words are left out."""
    texts = pa.array([r.text for r in rows], pa.string())
    shingles, at = read_shingles(texts, n)
    some = np.flatnonzero(np.diff(at))
    order = sorted(some.tolist(), key=lambda i: (rows[i].item_id is None, rows[i].item_id or 0, rows[i].text))
    items = [Item(rows[i].item_id, int(at[i + 1] - at[i]), *np.unique(shingles[at[i] : at[i + 1]], return_counts=True)) for i in order]
    return items, _fingerprints(_bit_sums(shingles, len(shingles)), at[:-1][order], at[1:][order]) if order else np.zeros(0, np.uint64)


def _passes(benchmark: DataFrame, n: int) -> Iterator[tuple[list[Item], np.ndarray]]:
    """The items in parts of about ``ITEMS_AT_ONCE``, what one pass over the documents holds."""
    known = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, -(-known.count() // ITEMS_AT_ONCE))
    for i in range(parts):
        yield read_items(known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == i).collect(), n)


def leaks(documents: DataFrame, benchmark: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """doc_id, text and ``hits`` of each row of ``documents`` (doc_id, text): the items (item_id, text) that it holds.

    A hit is an item whose weighted word shingles are similar by ``least`` or more to a stretch of
    the document; A-Z count as a-z.  Null or empty texts have no hits, and such items are in
    nothing; items of the same text are separate, repeated documents are searched each.  Other
    columns of both tables are ignored.  An empty benchmark gives empty lists, an empty table no rows.
    """
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.expr(f"cast(array() as {HITS})").alias("hits"))
    for items, prints in _passes(benchmark, words):
        found = found.mapInArrow(_scan(items, prints, words, least), f"doc_id long, text string, hits {HITS}")
    return found


def drop_leaks(documents: DataFrame, benchmark: DataFrame, words: int = 5, least: float = 0.8) -> DataFrame:
    """The rows of ``documents``, all columns whatever their names, for which ``leaks`` has no hit (so those without text stay)."""
    for items, prints in _passes(benchmark, words):
        documents = documents.mapInArrow(_clean(items, prints, words, least), documents.schema)
    return documents
