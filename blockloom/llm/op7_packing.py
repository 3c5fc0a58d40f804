"""Bounded-space online packing of token sequences.

Each partition reads its documents once and keeps a fixed number of open windows.  Whole windows
are cut off long documents; the rest goes to the open window that it fills best, and where none
has room the fullest one is emitted.  The windows still open at the end of the partitions are
merged in rounds, a bounded number of partitions at a time.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkernel import Buffer, pieces, tidy
from .tokenize import WordTokenizer

LENGTH = 2048
OPEN = 64
#: Partitions whose open windows are merged by one task of a round.
FAN_IN = 16
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary, open_in long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()), ("open_in", pa.int64())])


class Packer:
    """Open windows by room; a piece is (doc_id, start, length, crc, doc_tokens, ids)."""

    def __init__(self, length: int, most: int, first_id: int, out: list):
        self.length, self.most, self.next, self.out = length, most, first_id, out
        self.rooms: list[tuple[int, int]] = []
        self.held: dict[int, list] = {}

    def _emit(self, room: tuple[int, int], open_in: int = -1) -> None:
        at = 0
        for doc, start, n, crc, total, ids in self.held.pop(room[1]):
            self.out.append((doc, start, n, crc, total, room[1], at, ids, open_in))
            at += n

    def add(self, piece: tuple) -> None:
        n = piece[2]
        k = bisect_left(self.rooms, (n, -1))
        if k < len(self.rooms):
            room, name = self.rooms.pop(k)
        else:
            if len(self.rooms) == self.most:
                self._emit(self.rooms.pop(0))
            room, name = self.length, self.next
            self.next += 1
            self.held[name] = []
        self.held[name].append(piece)
        if room == n:
            self._emit((0, name))
        else:
            insort(self.rooms, (room - n, name))

    def close(self, open_in: int) -> None:
        """Emit the open windows, marked for the next round (or as final by -1)."""
        for room in self.rooms:
            self._emit(room, open_in)
        self.rooms = []


def _table(out: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out, strict=True), _ARROW, strict=True)], schema=_ARROW)


def _pack(path: str, length: int, most: int, end: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokenizer.of(path)
        part = TaskContext.get().partitionId()
        out: list = []
        packer = Packer(length, most, part << 32, out)
        for batch in pieces(batches, limit=4 << 20):
            ids, at = tokens.encode(Buffer(batch.column("text")))
            names = batch.column("doc_id").to_pylist()
            for i, doc in enumerate(names):
                own = np.append(ids[at[i] : at[i + 1]], np.uint32(end)).astype("<u4")
                for first in range(0, len(own), length):
                    held = own[first : first + length].tobytes()
                    packer.add((doc, first, len(held) // 4, zlib.crc32(held), len(own), held if with_ids else None))
                if len(out) > 5000:
                    yield _table(out)
                    out.clear()
        packer.close(part)
        if out:
            yield _table(out)

    return tidy(run)


def _merge(length: int, most: int, round_: int, last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        group = key[0].as_py()
        out: list = []
        packer = Packer(length, most, (1 << 62) + (round_ << 56) + (group << 32), out)
        rows = sorted(table.to_pylist(), key=lambda r: (-r["length"], r["sequence_id"], r["offset"]))
        for r in rows:
            packer.add((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"], r["ids"]))
        packer.close(-1 if last else group)
        return pa.Table.from_batches([_table(out)], schema=_ARROW)

    return run


def pack(documents: DataFrame, tokenizer: str, length: int = LENGTH, open_windows: int = OPEN, end: int = 1, with_ids: bool = True) -> DataFrame:
    """The pieces of all documents (doc_id, text), each with its place in a sequence of ``length`` ids at most.

    A document is its text's ids and then ``end`` (a null text is empty, so its piece is that id
    alone); ids is the piece's ids as little-endian unsigned 32-bit values (null without
    ``with_ids``) and ids_crc32 their checksum.  Every row is a document, repeated or null doc_ids
    included; other columns are ignored; no rows give no pieces.
    """
    scratch = Scratch(documents.sparkSession, "packing")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    done = scratch.save(docs.mapInArrow(_pack(tokenizer, length, open_windows, end, with_ids), SCHEMA), "round0")
    parts, round_ = [], 0
    groups = done.agg(F.max("open_in").alias("m")).first().m
    while groups is not None and groups >= 0:
        parts.append(done.where("open_in < 0"))
        round_ += 1
        groups //= FAN_IN
        merged = done.where("open_in >= 0").groupBy(F.floor(F.col("open_in") / FAN_IN).cast("long").alias("group")).applyInArrow(_merge(length, open_windows, round_, groups == 0), SCHEMA)
        done = scratch.save(merged, f"round{round_}")
        groups = groups if groups else -1
    parts.append(done)
    whole = parts[0]
    for x in parts[1:]:
        whole = whole.unionByName(x)
    return whole.drop("open_in")
