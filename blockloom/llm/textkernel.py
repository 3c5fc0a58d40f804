"""Vectorised text primitives shared by the operators: words, lines and their 64-bit hashes.

All functions work on the UTF-8 buffer of many documents at once.  A span's hash is a polynomial
over a table of random byte values modulo 2**64, read from prefix sums, so that hashing all words,
lines or windows of a buffer costs a few numpy passes whatever their number.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Odd multiplier of the polynomial (the golden ratio's 64 bits).
BASE = 0x9E3779B97F4A7C15
#: Text handled at once; larger only where one document is larger.
CHUNK_BYTES = 2 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of SplitMix64, a bijection of uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)
_fold = np.arange(256)
_fold[65:91] += 32
#: The same with A-Z as a-z.
FOLDED_VALUES = BYTE_VALUES[_fold]
FOLD = _fold.astype(np.uint8)
#: Space and the control characters 9 to 13.
IS_SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i up to n."""
    if len(_powers[0]) <= n:
        size = max(n + 1, CHUNK_BYTES + 1)
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][: n + 1], _powers[1][: n + 1]


class Buffer:
    """The texts of some rows as one byte buffer; a null text is empty."""

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        if texts.null_count:
            texts = texts.fill_null("")
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int64 if wide else np.int32, len(texts) + 1, texts.offset * (8 if wide else 4)).astype(np.int64) if offsets is not None and len(texts) else np.zeros(1, np.int64)
        first, last = int(at[0]), int(at[-1])
        self.data = np.frombuffer(data, np.uint8, last - first, first) if data is not None and last > first else np.zeros(0, np.uint8)
        self.starts, self.ends = at[:-1] - first, at[1:] - first
        self.n = len(texts)

    def __len__(self) -> int:
        return len(self.data)

    def prefix(self, values: np.ndarray = BYTE_VALUES) -> np.ndarray:
        """Prefix sums of the polynomial, for ``span_hashes``."""
        p = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(values[self.data] * powers(len(self.data))[0][:-1], out=p[1:])
        return p

    def runs(self, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs of ``member`` inside documents."""
        if not len(member):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        begins = member.copy()
        begins[1:] &= ~member[:-1]
        stops = member.copy()
        stops[:-1] &= ~member[1:]
        full = self.ends > self.starts
        begins[self.starts[full]] = member[self.starts[full]]
        stops[self.ends[full] - 1] = member[self.ends[full] - 1]
        return np.flatnonzero(begins), np.flatnonzero(stops) + 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        return self.runs(~IS_SPACE[self.data])

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the lines of all texts split at newlines (an empty text has one, empty, line)."""
        cuts = np.flatnonzero(self.data == 10)
        starts = np.concatenate([self.starts, cuts + 1])
        ends = np.concatenate([self.ends, cuts])
        starts.sort(kind="stable")
        ends.sort(kind="stable")
        return starts, ends

    def document_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1

    def split(self, at: np.ndarray) -> np.ndarray:
        """Offsets of each document's share of the sorted positions ``at`` (one more than documents)."""
        return np.append(np.searchsorted(at, self.starts, "left"), len(at))


def span_hashes(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    inverse = powers(len(prefix) - 1)[1]
    return mix((prefix[ends] - prefix[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes, by its first word (n - 1 fewer than words)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for j in range(n):
        total += words[j : j + m] * np.uint64(pow(BASE, 2 * j + 1, 1 << 64))
    return mix(total)


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """One document's n-word shingles in order; with fewer words, the whole sequence as one."""
    if 0 < len(words) < n:
        return mix(gram_hashes(words, len(words)) + np.uint64(len(words)))
    return gram_hashes(words, n)


def pieces(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text, a row at least."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if not batch.num_rows:
            continue
        sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32, len(column) + 1, column.offset * (8 if pa.types.is_large_string(column.type) else 4)).astype(np.int64))
        first, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(first, i - first)
                first, held = i, 0
            held += size + 64
        yield batch.slice(first)


def _give_back() -> None:
    """Freed memory of this process that its allocators still hold goes to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:  # glibc has it
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same kernel; at its end the worker, which idles and is used again, gives back what it freed."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _give_back()

    return tidied


def ragged(values: np.ndarray, offsets: np.ndarray, type_: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, type_))


def document_shingles(words: np.ndarray, cut: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``shingles`` of many documents, whose words lie between ``cut``: all in one array, and its offsets."""
    count = np.diff(cut)
    size = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(count)), size)
    out = np.zeros(at[-1], np.uint64)
    grams = gram_hashes(words, n)
    long_ = count[doc] >= n
    out[long_] = grams[(cut[:-1][doc] + np.arange(at[-1]) - at[:-1][doc])[long_]] if len(grams) else 0
    for i in np.flatnonzero((count > 0) & (count < n)).tolist():
        out[at[i]] = shingles(words[cut[i] : cut[i + 1]], n)[0]
    return out, at
