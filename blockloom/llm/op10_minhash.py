"""Near-duplicate documents by bottom-k sketches from one hash function.

A document's set holds the hashes of its distinct word shingles; its sketch is the k smallest of
them.  Equal sets collapse into one class first.  The inverted lists of the retained values
generate the candidates: two sets of similarity t or more keep at least ``least_overlap(k)``
values in common (with probability over 1 - 1e-9 for k = 64 and t = 0.85), so each class enters only
the lists of its rarest values, just enough of them that two such sketches must meet.  Every list
links its members to its first one (linear in its length); short lists that still span several
components are then compared across components.  The members of longer ones first pass the prefix
filter on full sets, which is exact, and meet those lists' least altered member; where components
remain apart, members are compared that share enough of their differences to that one, which
similar ones must, so that no link that could join two components is left out.
The union sketch estimates the similarity and removes hopeless pairs; the full sets
confirm the rest.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .scratch import Scratch
from .textkernel import FOLDED_VALUES, Buffer, pieces, shingles, span_hashes, tidy

SKETCH = 64
#: Chance that two similar sets keep less of their sketches in common than ``overlap`` says.
CHANCE = 1e-9
_SIGN = np.uint64(1 << 63)


def overlap(percent: int, k: int = SKETCH) -> float:
    """Share of a sketch that two similar sets keep in common at least, rounded down to hundredths."""
    t, below, c = percent / 100, 0.0, 0
    while c < k:
        below += math.comb(k, c) * t**c * (1 - t) ** (k - c)
        if below > CHANCE:
            break
        c += 1
    return (100 * c // k) / 100


def _sets(words: int, k: int, whole: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            buffer = Buffer(part.column("text"))
            starts, ends = buffer.words()
            hashes = span_hashes(buffer.prefix(FOLDED_VALUES), starts, ends)
            cut = buffer.split(starts)
            sizes, keys, full, kept = [], [], [], []
            for i in range(buffer.n):
                found = np.unique(shingles(hashes[cut[i] : cut[i + 1]], words))
                sizes.append(len(found))
                held = found.tobytes()
                keys.append(xxhash.xxh3_128_digest(held))
                full.append(held)
                kept.append(found[:k] ^ _SIGN)
            at = np.concatenate([[0], np.cumsum([len(x) for x in kept])])
            sketch = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(kept).view(np.int64)))
            held = {"doc_id": part.column("doc_id"), "text_hash": part.column("text_hash"), "n": pa.array(sizes, pa.int32()), "key": pa.array(keys, pa.binary())}
            held |= {"full": pa.array(full, pa.binary())} if whole else {"sketch": sketch}
            yield pa.RecordBatch.from_arrays(list(held.values()), list(held))

    return tidy(run)


def _confirm(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = []
            for a, b in zip(batch.column("full_u"), batch.column("full_v"), strict=True):
                x, y = np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                shared = int((y[at] == x).sum())
                same.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(same, pa.bool_()))

    return tidy(run)


@dataclass
class _Corpus:
    """The input, one class for each distinct set, and how to get whole sets again."""

    texts: DataFrame
    classes: DataFrame
    percent: int
    words: int
    k: int
    scratch: Scratch
    count: Iterator[int] = field(default_factory=itertools.count)

    def sets(self, reps: DataFrame) -> DataFrame:
        """(rep, n, full) of some classes, made again from their texts: only these are moved."""
        some = self.classes.join(reps.select("rep").distinct(), "rep", "left_semi").select("rep", "key", F.col("doc_id").alias("d"), F.col("text_hash").alias("t"))
        held = self.texts.join(some.select("d", "t"), F.expr("doc_id <=> d and text_hash = t"), "left_semi")
        made = held.mapInArrow(_sets(self.words, self.k, True), "doc_id long, text_hash long, n int, key binary, full binary")
        return made.groupBy("key").agg(F.first("n").alias("n"), F.first("full").alias("full")).join(some.select("rep", "key"), "key").select("rep", "n", "full")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs (u, v) of classes whose sets are similar: the union sketch's estimate, then the full sets."""
        of = lambda at: self.classes.select(F.col("rep").alias(at), F.col("sketch").alias(f"sketch_{at}"))
        both = pairs.join(of("u"), "u").join(of("v"), "v")
        union = F.slice(F.array_sort(F.array_union("sketch_u", "sketch_v")), 1, self.k)
        t = self.percent / 100
        # five and a half standard deviations below the threshold
        least = F.lit(t) - 5.5 * math.sqrt(t * (1 - t)) / F.sqrt(F.size("union"))
        likely = both.withColumn("union", union).where(F.size(F.array_intersect("union", F.array_intersect("sketch_u", "sketch_v"))) >= least * F.size("union")).select("u", "v")
        likely = self.scratch.save(likely, f"likely{next(self.count)}")
        sets = self.scratch.save(self.sets(likely.select(F.explode(F.array("u", "v")).alias("rep"))), f"sets{next(self.count)}")
        held = lambda at: sets.select(F.col("rep").alias(at), F.col("full").alias(f"full_{at}"))
        return likely.join(held("u"), "u").join(held("v"), "v").mapInArrow(_confirm(self.percent), "u long, v long")


@tidy
def _values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rep, n, full in zip(batch.column("rep"), batch.column("n"), batch.column("full"), strict=True):
            value = np.frombuffer(full.as_buffer(), np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(value), rep.as_py())), pa.array(np.full(len(value), n.as_py(), np.int32)), pa.array(value)], ["rep", "n", "value"])


def _exact_lists(sets: DataFrame, percent: int) -> DataFrame:
    """(value, rep, n, unique): the prefix filter on full sets, for the members of crowded lists.

    ``unique`` counts a set's values that no other of these sets has.  A set with more than
    (1 - t) n of them is similar to none.  The rest enter the lists of their rarest values, so many
    that two similar sets must meet.
    """
    values = sets.mapInArrow(_values, "rep long, n int, value long")
    df = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    ranked = values.join(df, "value").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("common"))
    room = F.floor(F.col("n") * (100 - percent) / 100).cast("int") + 1 - F.col("unique")
    entered = ranked.withColumn("unique", F.col("n") - F.size("common")).withColumn("room", room).where("room > 0")
    return entered.select("rep", "n", "unique", F.explode(F.slice("common", F.lit(1), F.col("room"))).alias("x")).select("rep", "n", "unique", F.col("x.value").alias("value"))


@tidy
def _differences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for p, rep, n, a, b in zip(*(batch.column(c) for c in ("u", "rep", "n", "full_u", "full_v")), strict=True):
            value = np.setxor1d(np.frombuffer(a.as_buffer(), np.uint64), np.frombuffer(b.as_buffer(), np.uint64), assume_unique=True).view(np.int64)
            k = len(value)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, p.as_py())), pa.array(np.full(k, rep.as_py())), pa.array(np.full(k, n.as_py(), np.int32)), pa.array(np.full(k, k, np.int32)), pa.array(value)], ["u", "rep", "n", "size", "value"])


def _difference_lists(exact: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(value, rep, n, unique, size, place): the prefix filter on each set's difference to its lists' pivots.

    If A and B are similar and A is not similar to a set P, then A and B share an element of their
    symmetric differences to P (else these would add up to more than similar sets may differ in).
    The difference of A and B is that of their differences, so two of these must meet among their
    d + 1 rarest elements, where d is what sets similar to A may differ from it in.  ``place`` counts
    the difference's elements that are rarer still than the value, for ``_differ``.
    """
    pivots = exact.groupBy("value").agg(F.min(F.struct("unique", "rep")).alias("p")).select("value", F.col("p.rep").alias("u"))
    held = lambda at, name: sets.select(F.col("rep").alias(at), F.col("full").alias(name))
    pairs = exact.join(pivots, "value").where("rep <> u").select("u", "rep", "n").distinct()
    rows = pairs.join(held("u", "full_u"), "u").join(held("rep", "full_v"), "rep").mapInArrow(_differences, "u long, rep long, n int, size int, value long")
    df = rows.groupBy("u", "value").agg(F.count("*").alias("df")).where("df > 1")
    ranked = rows.join(df, ["u", "value"]).groupBy("u", "rep", "n", "size").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("common"))
    room = F.floor(F.col("n") * (100 - percent) / percent).cast("int") + 1 - F.col("unique")
    entered = ranked.withColumn("unique", F.col("size") - F.size("common")).withColumn("room", room).where("room > 0")
    listed = entered.select("u", "rep", "n", "unique", "size", F.posexplode(F.slice("common", F.lit(1), F.col("room"))).alias("at", "x"))
    return listed.select(F.xxhash64("u", "x.value").alias("value"), "rep", "n", "unique", "size", (F.col("unique") + F.col("at")).alias("place")).distinct()


def _alike(percent: int, n: str, m: str) -> str:
    return f"100 * least({n}, {m}) >= {percent} * greatest({n}, {m})"


def _fewer(lists: DataFrame, percent: int) -> str:
    """Two similar sets differ in (1 - t) / t of the smaller one at most, so in all their unique values, and their differences to a third set in size."""
    sums = [x for c, x in (("unique", "unique + unique_u"), ("size", "abs(size - size_u)")) if c in lists.columns]
    return " and ".join(f"{percent} * ({x}) <= {100 - percent} * least(n, n_u)" for x in sums) or "true"


def _differ(lists: DataFrame, percent: int) -> str:
    """Whether a value can be the rarest that two differences share.

    Similar sets A and B differ in d elements at most, so their differences to the same set share
    (|A| + |B| - d) / 2 or more, all of them from the rarest one on; no more than what is left of
    either from there can be shared.
    """
    if "place" not in lists.columns:
        return "true"
    d = f"least({100 - percent} * (n + n_u) / {100 + percent}, {100 - percent} * least(n, n_u) / {percent})"
    return f"2 * least(size - place, size_u - place_u) >= size + size_u - {d} - 0.001"


def _to_pivots(lists: DataFrame, order: tuple[str, ...], percent: int) -> DataFrame:
    """Each list's members with its first one in the given order: as many pairs as members."""
    held = [c for c in ("n", "unique") if c in lists.columns]
    pivots = lists.groupBy("value").agg(F.min(F.struct(*order, *[c for c in held if c not in order])).alias("p"))
    pivots = pivots.select("value", F.col("p.rep").alias("u"), *[F.col(f"p.{c}").alias(f"{c}_u") for c in held])
    return lists.join(pivots, "value").where("rep <> u").where(_alike(percent, "n", "n_u")).where(_fewer(lists, percent)).select(F.least("u", "rep").alias("u"), F.greatest("u", "rep").alias("v")).distinct()


def _with_roots(lists: DataFrame, joined: DataFrame) -> DataFrame:
    return lists.join(joined.withColumnRenamed("node", "rep"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))


def _open(member: DataFrame) -> DataFrame:
    """The lists of several components, with their number of members and most frequent component."""
    sizes = member.groupBy("value", "root").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("value").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.count("*").alias("roots"), F.sum("c").alias("members")).where("roots > 1")
    return member.join(mixed.drop("roots"), "value")


def _across(open_: DataFrame, percent: int) -> DataFrame:
    """Pairs of list members of different components: all outside the main component with all others."""
    held = [c for c in ("n", "unique", "size", "place") if c in open_.columns]
    minor = open_.where("root <> main").select("value", F.col("rep").alias("u"), F.col("root").alias("root_u"), *[F.col(c).alias(f"{c}_u") for c in held])
    met = open_.join(minor, "value").where("root_u <> root and (root = main or u < rep)")
    return met.where(_alike(percent, "n", "n_u")).where(_fewer(open_, percent)).where(_differ(open_, percent)).select(F.least("u", "rep").alias("u"), F.greatest("u", "rep").alias("v")).distinct()


def resolve(documents: DataFrame, percent: int = 85, words: int = 5, k: int = SKETCH, block: int = 32) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every row of ``documents`` (doc_id, text).

    Similar means ``100 * intersection >= percent * union`` of the shingle sets; the component is
    that of the similarity graph, named by its smallest doc_id.  A text that is null or has no
    word has an empty set and is linked with nothing; shorter texts than a shingle count as one
    shingle.  Rows that repeat a doc_id are all returned; a null doc_id is smaller than none, and
    its row is never ``kept``.  ``stays`` marks one row of each component, the first by doc_id,
    whatever doc_ids are null or repeated, and every row without words.  Other columns are
    ignored.  An empty table gives an empty result.
    """
    spark: SparkSession = documents.sparkSession
    scratch = Scratch(spark, "minhash")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text"))
    made = texts.mapInArrow(_sets(words, k), "doc_id long, text_hash long, n int, key binary, sketch array<long>")
    docs = scratch.save(made.withColumn("row_id", F.monotonically_increasing_id()), "docs")
    named = scratch.save(docs.where("n > 0").groupBy("key").agg(F.min("row_id").alias("rep"), F.min("doc_id").alias("lowest"), F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row_id")).alias("first")), "named")
    classes = scratch.save(docs.join(named.select(F.col("rep").alias("row_id")), "row_id", "left_semi").withColumnRenamed("row_id", "rep"), "classes")
    corpus = _Corpus(texts, classes, percent, words, k, scratch)

    postings = classes.select("rep", "n", F.explode("sketch").alias("value"))
    shared = postings.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    ranked = postings.join(shared, "value").groupBy("rep", "n").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("common"))
    held = F.least(F.col("n"), F.lit(k))
    entered = held - F.floor(held * overlap(percent, k)).cast("int") + 1 - (held - F.size("common"))
    lists = scratch.save(
        ranked.withColumn("entered", F.least(entered, F.size("common"))).where("entered > 0").select("rep", "n", F.explode(F.slice("common", F.lit(1), F.col("entered"))).alias("x")).select("rep", "n", F.col("x.value").alias("value")),
        "lists",
    )

    first = scratch.save(corpus.links(_to_pivots(lists, ("rep",), percent)), "links1")
    member = scratch.save(_with_roots(lists, components(first, scratch, "a")), "member")
    open_ = scratch.save(_open(member), "open")
    scratch.drop("lists", "member")
    crowded = scratch.save(corpus.sets(open_.where(F.col("members") > block).select("rep")), "crowded")
    exact = scratch.save(_exact_lists(crowded, percent), "exact")
    second = _across(open_.where(F.col("members") <= block), percent).union(_to_pivots(exact, ("unique", "rep"), percent))
    most = scratch.save(first.union(corpus.links(second.distinct())), "links2")
    apart = scratch.save(_difference_lists(exact, crowded, percent), "apart")
    fourth = _across(_open(_with_roots(apart, components(most, scratch, "b"))), percent)
    final = components(most.union(corpus.links(fourth)), scratch, "c")

    class_of = named.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("key", "lowest", "first", F.coalesce("root", "rep").alias("root"))
    lowest = class_of.groupBy("root").agg(F.min("lowest").alias("component_id"), F.min("first").alias("chosen"))
    labelled = scratch.save(class_of.drop("first").join(lowest, "root").select("key", "component_id", F.col("chosen.row_id").alias("chosen")), "labelled")
    scratch.drop("classes", "links1", "open", "crowded", "exact", "links2", "apart", *(f"{x}{i}" for x in ("likely", "sets") for i in range(next(corpus.count))))
    rows = docs.select("doc_id", "text_hash", "row_id", "n", F.when(F.col("n") > 0, F.col("key")).alias("key"))
    own = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.join(labelled, "key", "left").select(
        "doc_id", "text_hash", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"),
        F.coalesce(F.col("doc_id") == own, F.lit(False)).alias("kept"), F.coalesce(F.col("row_id") == F.col("chosen"), F.lit(True)).alias("stays"),
    )


def near_duplicates(documents: DataFrame, percent: int = 85, words: int = 5, k: int = SKETCH, block: int = 32) -> DataFrame:
    """The columns doc_id, n_shingles, component_id and kept of ``resolve``."""
    return resolve(documents, percent, words, k, block).select("doc_id", "n_shingles", "component_id", "kept")


def drop_near_duplicates(documents: DataFrame, percent: int = 85, words: int = 5, k: int = SKETCH) -> DataFrame:
    """The rows of ``documents``, all columns, without all but one of each group of near duplicates; texts without words stay.

    The one is the first by doc_id (null: last); of rows that repeat its doc_id and text that of
    the least other columns, written as JSON, stays.  An empty table gives no rows.
    """
    stays = resolve(documents, percent, words, k).where("stays and n_shingles > 0").select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"))
    # the rows as one column, so that no name in them can clash
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in documents.columns]).alias("row"))
    keyed = rows.select("row", F.col("row")["doc_id"].cast("long").alias("id"), F.col("row")["text"].cast("string").alias("text"))
    wordy = F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    hashed = keyed.where(wordy).select("row", "id", F.xxhash64("text").alias("hash"))
    kept = hashed.join(stays, F.expr("id <=> s_id and hash = s_hash"), "left_semi")
    rest = F.struct(F.lit(0), *[F.col("row")[c] for c in documents.columns if c != "text"])
    one = kept.groupBy("id", "hash").agg(F.min_by("row", F.to_json(rest)).alias("row")).select("row")
    return one.union(keyed.where(~wordy).select("row")).select("row.*")
