"""Line dedup by pairwise alignment.

Documents that may overlap are found through shared lines, short ones by runs of lines: a rare line
links its documents to the first of them and to the one before; a frequent line links to its first
document, and together with the next line to the first document of both, so that the links grow with
the lines and not with the square of a group.  Each linked pair is aligned by patience diff over line hashes, and aligned
common blocks go from the later document.  Exact copies are one class: its first document stands
for it, and the others are blocks as a whole.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkernel import Buffer, gram_hashes, mix, pieces, span_hashes, tidy

#: Words that a linking line and a removed block have at least.
WORDS = 5
#: Documents that share a rare line at most; a more frequent one links to its first document only.
RARE = 64


@tidy
def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches):
        buffer = Buffer(part.column("text"))
        starts, ends = buffer.lines()
        word_starts = buffer.words()[0]
        n_words = (np.searchsorted(word_starts, ends, "left") - np.searchsorted(word_starts, starts, "left")).astype(np.int32)
        hashes = span_hashes(buffer.prefix(), starts, ends).view(np.int64)
        cuts = np.flatnonzero(buffer.data == 10)
        count = 1 + np.searchsorted(cuts, buffer.ends, "left") - np.searchsorted(cuts, buffer.starts, "left")
        at = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
        keys = [xxhash.xxh3_128_digest(buffer.data[a:b]) for a, b in zip(buffer.starts, buffer.ends, strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(at, pa.array(hashes)), pa.ListArray.from_arrays(at, pa.array(n_words))], ["doc_id", "text_hash", "key", "lines", "words"])


def _seeds(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, keys, pairs, news = [], [], [], []
            for rank, lines, words in zip(batch.column("rep"), batch.column("lines"), batch.column("words"), strict=True):
                h, w = np.asarray(lines.values).view(np.uint64), np.asarray(words.values)
                h, w = h[w > 0], w[w > 0].astype(np.int64)
                total = np.concatenate([[0], np.cumsum(w)])
                # each line's run ends where it has enough words; a line of as many is a run by itself
                end = np.searchsorted(total, total[:-1] + least, "left")
                own = np.flatnonzero(end <= len(h))
                key, size = h[own].copy(), end[own] - own
                for n in np.unique(size[size > 1]).tolist():
                    key[size == n] = mix(gram_hashes(h, n)[own[size == n]] + np.uint64(n))
                after = np.flatnonzero(end[own] < len(h))
                pair = np.zeros(len(own), np.uint64)
                pair[after] = mix(key[after] + mix(h[end[own][after]]))
                new = np.zeros(len(own), np.int8)
                new[np.unique(key, return_index=True)[1]] = 1
                reps.append(np.full(len(own), rank.as_py(), np.int64))
                keys.append(key.view(np.int64))
                pairs.append(pair.view(np.int64))
                news.append(new)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*x, np.zeros(0, t)])) for x, t in ((reps, np.int64), (keys, np.int64), (pairs, np.int64), (news, np.int8))], ["rep", "line", "pair", "new"])

    return tidy(run)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned equal positions of two line lists: common ends, then the longest increasing run of lines unique in both, in between again."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        ca, cb = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {x: i for i, x in enumerate(a[a0:a1], a0) if ca[x] == 1 and cb.get(x) == 1}
        piles: list[int] = []
        tops: list[tuple[int, int]] = []
        back: dict[tuple[int, int], tuple[int, int] | None] = {}
        for j in range(b0, b1):
            i = where.get(b[j])
            if i is not None:
                k = bisect_left(piles, i)
                back[i, j] = tops[k - 1] if k else None
                piles[k : k + 1] = [i]
                tops[k : k + 1] = [(i, j)]
        chain, at = [], tops[-1] if tops else None
        while at:
            chain.append(at)
            at = back[at]
        chain.reverse()
        if chain:
            x, y = a0, b0
            for i, j in chain:
                todo.append((x, i, y, j))
                out.append((i, j))
                x, y = i + 1, j + 1
            todo.append((x, a1, y, b1))
    return sorted(out)


def common_blocks(a: list[int], b: list[int], words: list[int], least: int) -> list[tuple[int, int]]:
    """Stretches of ``b`` (first line, end) that stand in ``a`` too, aligned, with ``least`` words or more."""
    blocks: list[list[int]] = []
    last = (-2, -2)
    for i, j in patience(a, b):
        if (i, j) == (last[0] + 1, last[1] + 1):
            blocks[-1][1] = j + 1
        else:
            blocks.append([j, j + 1])
        last = (i, j)
    return [(x, y) for x, y in blocks if sum(words[x:y]) >= least]


def _align(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reps, firsts, ends = [], [], []
            for rep, *sides in zip(*(batch.column(c) for c in ("later", "lines_a", "lines_b", "words")), strict=True):
                for x, y in common_blocks(*(np.asarray(side.values).tolist() for side in sides), least):
                    reps.append(rep.as_py())
                    firsts.append(x)
                    ends.append(y)
            yield pa.RecordBatch.from_arrays([pa.array(reps, pa.int64()), pa.array(firsts, pa.int32()), pa.array(ends, pa.int32())], ["rep", "first", "end"])

    return tidy(run)


@tidy
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches (row, text, copy, blocks) with what is left of the text, and what went."""
    for batch in batches:
        texts, totals, removed, sums = [], [], [], []
        for text, whole, blocks in zip(*(batch.column(c) for c in ("text", "copy", "blocks")), strict=True):
            text = text.as_py()
            lines = (text or "").split("\n")
            gone = np.full(len(lines), bool(whole.as_py()))
            for x in blocks.as_py() or []:
                gone[x["first"] : x["end"]] = True
            kept = "\n".join(x for x, g in zip(lines, gone, strict=True) if not g) if gone.any() else text
            texts.append(kept)
            totals.append(len(lines))
            removed.append(int(gone.sum()))
            sums.append(hashlib.sha256((kept or "").encode("utf-8", "replace")).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(sums, pa.string())], ["row", "text", "n_lines", "n_removed", "kept_sha256"])


def _deduped(documents: DataFrame, row: Column, least: int, rare: int) -> DataFrame:
    """(row, text, n_lines, n_removed, kept_sha256), where ``row`` is carried through as one column, so that no name in it can clash."""
    scratch = Scratch(documents.sparkSession, "lines")
    text = F.col("text").cast("string")
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    read = scratch.save(docs.mapInArrow(_read, "doc_id long, text_hash long, key binary, lines array<long>, words array<int>"), "read")
    sized = read.where(F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x) >= least)
    # the first document stands for its class; rep numbers classes in the order of those
    first = sized.groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash")).alias("f"), F.first("lines").alias("lines"), F.first("words").alias("words"))
    ordered = first.orderBy("f").withColumn("rep", F.monotonically_increasing_id())
    classes = scratch.save(ordered.select("key", "rep", F.col("f.doc_id").alias("first_id"), F.col("f.text_hash").alias("first_hash"), "lines", "words"), "classes")
    seeds = scratch.save(classes.select("rep", "lines", "words").mapInArrow(_seeds(least), "rep long, line long, pair long, new byte"), "seeds")
    often = seeds.groupBy("line").agg(F.sum("new").alias("df"), F.min("rep").alias("start")).where("df > 1")
    known = scratch.save(seeds.join(often, "line"), "known")
    single = known.where((F.col("df") <= rare) & (F.col("new") == 1)).select("line", "rep", "start")
    before = F.lag("rep").over(Window.partitionBy("line").orderBy("rep"))
    near = single.select(F.col("rep").alias("later"), before.alias("before"), "start").select("later", F.explode(F.array("before", "start")).alias("earlier"))
    frequent = known.where(F.col("df") > rare)
    double = frequent.where(F.col("pair") != 0).select("pair", "rep")
    pivots = double.groupBy("pair").agg(F.min("rep").alias("earlier"))
    far = double.join(pivots, "pair").select(F.col("rep").alias("later"), "earlier")
    pairs = scratch.save(near.union(frequent.select("rep", "start")).union(far).where("earlier < later").distinct(), "pairs")
    left = classes.select(F.col("rep").alias("earlier"), F.col("lines").alias("lines_a"))
    right = classes.select(F.col("rep").alias("later"), F.col("lines").alias("lines_b"), "words")
    found = pairs.join(left, "earlier").join(right, "later").mapInArrow(_align(least), "rep long, first int, end int")
    blocks = found.distinct().groupBy("rep").agg(F.collect_list(F.struct("first", "end")).alias("blocks"))
    copies = read.join(classes.select("key", "first_id", "first_hash"), "key").where("not (doc_id <=> first_id and text_hash = first_hash)").select("doc_id", "text_hash", F.lit(True).alias("copy"), F.lit(None).cast("array<struct<first:int,end:int>>").alias("blocks"))
    cut = blocks.join(classes, "rep").select(F.col("first_id").alias("doc_id"), F.col("first_hash").alias("text_hash"), F.lit(False).alias("copy"), "blocks")
    actions = scratch.save(copies.union(cut).dropDuplicates(["doc_id", "text_hash"]).select(F.col("doc_id").alias("action_id"), F.col("text_hash").alias("action_hash"), "copy", "blocks"), "actions")
    scratch.drop("read", "classes", "seeds", "known", "pairs")
    rows = documents.select(row.alias("row"), F.col("doc_id").cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("own"))
    joined = rows.join(actions, F.expr("id <=> action_id and own = action_hash"), "left").select("row", "text", "copy", "blocks")
    return joined.mapInArrow(_cut, f"{joined.select('row')._jdf.schema().toDDL()}, text string, n_lines long, n_removed long, kept_sha256 string")


def dedup_lines(documents: DataFrame, least: int = WORDS, rare: int = RARE) -> DataFrame:
    """doc_id, the remaining text, n_lines, n_removed and kept_sha256 of each row of ``documents`` (doc_id, text).

    The later document is that of the larger doc_id (null: last).  Rows that repeat both doc_id
    and text are one document and get the same result.  A null or empty text has one line, without
    words, and loses nothing; a text of fewer than ``least`` words is never a copy.  Blocks are
    judged on the input, not on what other alignments leave.  Other columns are ignored; an empty
    table gives no rows.
    """
    return _deduped(documents, F.col("doc_id").cast("long"), least, rare).withColumnRenamed("row", "doc_id")


def drop_lines(documents: DataFrame, least: int = WORDS, rare: int = RARE) -> DataFrame:
    """The rows of ``documents``, all columns, with the text that ``dedup_lines`` leaves.

    A row of whose words nothing is left goes.  Rows without words in the input stay as they are.
    A column n_chars, if there is one, gets the length of a changed text.
    """
    done = _deduped(documents, F.struct(*[F.col(f"`{c}`") for c in documents.columns]), least, rare)
    size = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("row")["n_chars"]) if "n_chars" in documents.columns else None
    new = {"text": F.col("text").cast(documents.schema["text"].dataType)} | ({} if size is None else {"n_chars": size.cast(documents.schema["n_chars"].dataType)})
    left = done.where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return left.select(*[new.get(c, F.col("row")[c]).alias(c) for c in documents.columns])
