"""Scoring documents by cross-entropy difference of two n-gram models.

Target (documents labelled as good) and background (all documents) models are interpolated bigram
models over one shared vocabulary: the words that occur most, an unknown word for the rest, and a
start mark as the context of a document's first word.  The vocabulary has ``MOST`` words at most
(a bound of the models; below it every word is in).  Every pair of neighbouring words is counted
exactly, in tables that grow with the corpus and are joined with the documents' pairs, never sent
to a task as a whole.  The background's counts are scaled to the target's number of tokens, so
that both are smoothed alike.  A token's score is its loss under the background less its loss under
the target; a document's is the mean.

    P(w) = (c(w) + 1) / (N + V + 1)        for V words and the unknown one
    P(w | v) = (c(v, w) + PRIOR P(w)) / (c(v) + PRIOR)

A pair that occurs once in the corpus is kept in no table: what a document's pair finds no entry
for occurs in this document alone.  The pairs that occur most (``HOT`` at most) are looked up where
the text is read; each other one of a document is first taken to be its own, and corrected by the
join with the table, so that frequent pairs are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkernel import FOLDED_VALUES, Buffer, pieces, span_hashes

#: Words of the shared vocabulary at most.
MOST = 1 << 18
#: Weight of the unigram model in a bigram's estimate, in counts.
PRIOR = 4.0
#: Most frequent pairs that are sent to the tasks, at most; all others are joined.
HOT = 1 << 18
_START = np.uint64(0x53A9E1F04C7D2B68)


@dataclass
class Tokens:
    """The words of some texts as hashes with their text's number, where each text's words begin, and each text's number of words."""

    doc: np.ndarray
    word: np.ndarray
    first: np.ndarray
    count: np.ndarray


def read_tokens(texts: pa.Array) -> Tokens:
    buffer = Buffer(texts)
    starts, ends = buffer.words()
    words = span_hashes(buffer.prefix(FOLDED_VALUES), starts, ends)
    cut = buffer.split(starts)
    count = np.diff(cut)
    return Tokens(np.repeat(np.arange(buffer.n), count), words, cut[:-1][count > 0], count)


def _target(part: pa.RecordBatch) -> np.ndarray:
    return np.asarray(part.column("target").cast(pa.int8())).astype(np.int64)


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values start in sorted ``keys``, and their lengths."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return first, np.diff(np.append(first, len(keys)))


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each word occurs, and is the word before another, in all documents and in the target."""
    for part in pieces(batches):
        tokens = read_tokens(part.column("text"))
        good = _target(part)
        words, at = np.unique(tokens.word, return_inverse=True)
        k, last = len(words), tokens.first + tokens.count[tokens.count > 0] - 1
        n, own = np.bincount(at, minlength=k), np.bincount(at, good[tokens.doc], k).astype(np.int64)
        ctx, own_ctx = n - np.bincount(at[last], minlength=k), own - np.bincount(at[last], good[tokens.doc[last]], k).astype(np.int64)
        start = 0, len(last), 0, int(good[tokens.doc[last]].sum())
        held = [np.append(x, s) for x, s in zip((n, ctx, own, own_ctx), start, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(words, _START).view(np.int64)), *(pa.array(x) for x in held)], ["word", "n", "ctx", "target_n", "target_ctx"])


@dataclass
class Vocabulary:
    """Word hashes in order (number i + 1 is word i's; 0 is the unknown word, the last one the start mark), with their counts."""

    hashes: np.ndarray
    #: n, ctx, target_n, target_ctx by number
    counts: np.ndarray

    @property
    def size(self) -> int:
        return len(self.hashes) + 2

    def numbers(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(words), np.int64)
        at = np.searchsorted(self.hashes, words)
        at[at == len(self.hashes)] = 0
        return np.where(self.hashes[at] == words, at + 1, 0)

    def pairs(self, tokens: Tokens) -> np.ndarray:
        """One number for each token and the one before it."""
        word = self.numbers(tokens.word)
        before = np.roll(word, 1)
        before[tokens.first] = self.size - 1
        return before * self.size + word

    def scale(self) -> float:
        """What background counts are multiplied by."""
        return max(1, int(self.counts[2].sum())) / max(1, int(self.counts[0].sum()))

    def weights(self) -> np.ndarray:
        """Prior and context weight of the target model, and of the background model, by number."""
        out = []
        for n, ctx, scale in ((self.counts[2], self.counts[3], 1.0), (self.counts[0], self.counts[1], self.scale())):
            out += [PRIOR * (n * scale + 1) / (n.sum() * scale + self.size - 1), ctx * scale + PRIOR]
        return np.stack(out)


@dataclass
class Model:
    """What the tasks know: the vocabulary, its weights, and the most frequent pairs in order with their counts (target, all)."""

    words: Vocabulary
    weights: np.ndarray
    pairs: np.ndarray
    counts: np.ndarray

    def losses(self, pair: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Loss of each pair under target and background, and whether it is a frequent one; others count once, in a document that is ``target`` or not."""
        v, w = np.divmod(pair, self.words.size)
        hot, own, everywhere = np.zeros(len(pair), bool), target.astype(float), np.ones(len(pair))
        if len(self.pairs):
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            hot = self.pairs[at] == pair
            own, everywhere = np.where(hot, self.counts[0, at], own), np.where(hot, self.counts[1, at], everywhere)
        found = [np.log(self.weights[i + 1, v]) - np.log(n + self.weights[i, w]) for i, n in ((0, own), (2, everywhere * self.words.scale()))]
        return found[0], found[1], hot


def _least(sizes: DataFrame, most: int) -> int | None:
    """The lowest grade down to which all grades together have ``most`` rows at most."""
    held, least = 0, None
    for r in sorted(sizes.groupBy("grade").agg(F.count("*").alias("k")).collect(), reverse=True):
        if (held := held + r.k) > most:
            break
        least = r.grade
    return least


def _grade(count: str) -> Column:
    """The class of a count, four to a doubling."""
    return F.floor(F.log2(count) * 4)


def vocabulary(rows: DataFrame, scratch: Scratch, most: int = MOST) -> Vocabulary:
    """The words of the highest counts, as many classes of counts (four to a doubling) as stay within ``most`` words."""
    words = scratch.save(rows.mapInArrow(_words, "word long, n long, ctx long, target_n long, target_ctx long").groupBy("word").agg(*[F.sum(c).alias(c) for c in ("n", "ctx", "target_n", "target_ctx")]), "words")
    start = int(_START.astype(np.int64))
    real = F.col("word") != start
    least = _least(words.where(real & (F.col("n") > 0)).select(_grade("n").alias("grade")), most)
    kept = words.where(~real if least is None else ~real | (_grade("n") >= least)).orderBy("word").toArrow()
    total = words.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("n", "ctx", "target_n", "target_ctx")]).first()
    hashes = kept.column("word").to_numpy().view(np.uint64)
    counts = np.stack([kept.column(c).to_numpy() for c in ("n", "ctx", "target_n", "target_ctx")])
    order = np.argsort(hashes, kind="stable")
    own = order[hashes[order] != _START]
    first = counts[:, hashes == _START].sum(axis=1)
    unknown = np.array(tuple(total), np.int64) - counts.sum(axis=1)
    return Vocabulary(hashes[own], np.concatenate([unknown[:, None], counts[:, own], first[:, None]], axis=1))


def _counts(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            tokens = read_tokens(part.column("text"))
            keys = np.sort(held.value.pairs(tokens) * 2 + _target(part)[tokens.doc])
            first, n = _runs(keys >> 1)
            good = np.add.reduceat(keys & 1, first) if len(first) else first
            yield pa.RecordBatch.from_arrays([pa.array(keys[first] >> 1), pa.array(n), pa.array(good)], ["pair", "n", "target_n"])

    return run


def _read(model):
    """A row for each document (its pair is negative) with its tokens and its losses as far as known here, and its distinct pairs that are not frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = model.value
        for part in pieces(batches):
            tokens = read_tokens(part.column("text"))
            good, rows, docs = _target(part), part.column("row").to_numpy(), len(tokens.count)
            square = known.words.size**2
            keys = np.sort(tokens.doc * square + known.words.pairs(tokens))
            first, n = _runs(keys)
            doc, pair = np.divmod(keys[first], square)
            target, background, hot = known.losses(pair, good[doc])
            cold = np.flatnonzero(~hot)
            sums = [np.bincount(doc, x * n, docs) for x in (target, background)]
            base = pa.StructArray.from_arrays([part.column("doc_id"), *(pa.array(x) for x in sums)], names=["doc_id", "target", "all"])
            row = rows * 2 + good
            columns = [
                pa.array(np.concatenate([row, row[doc[cold]]])),
                pa.array(np.concatenate([-1 - rows, pair[cold]])),
                pa.array(np.concatenate([tokens.count, n[cold]])),
                pa.concat_arrays([base, pa.nulls(len(cold), base.type)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "pair", "n", "base"])

    return run


def score(documents: DataFrame, target: DataFrame, most: int = MOST, hot: int = HOT) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score of each row of ``documents`` (doc_id, text).

    ``target`` lists the doc_ids of the target corpus.  Losses are nats a token; a text without
    words (or null) has none (null).  Repeated rows are counted and scored each; a null doc_id is
    background only; without target documents the target model is uniform.  Words are told apart
    by 64-bit hashes, A-Z counts as a-z.  Other columns are ignored; an empty table gives no rows.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "lm")
    good = target.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct().withColumn("target", F.lit(True))
    text = F.col("text").cast("string")
    plain = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    # merged by sorted keys whatever the lists' size, so that a step costs the same a byte everywhere
    rows = scratch.save(plain.join(good.hint("merge"), "doc_id", "left").select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.coalesce("target", F.lit(False)).alias("target")), "rows")
    held = vocabulary(rows, scratch, most)
    shared = spark.sparkContext.broadcast(held)
    known = rows.select("text", "target").mapInArrow(_counts(shared), "pair long, n long, target_n long").groupBy("pair").agg(F.sum("n").alias("all_n"), F.sum("target_n").alias("target_n")).where("all_n > 1")
    known = scratch.save(known, "pairs")
    least = _least(known.select(_grade("all_n").alias("grade")), hot)
    frequent = F.lit(False) if least is None else _grade("all_n") >= least
    often = known.where(frequent).orderBy("pair").toArrow()
    weights = held.weights()
    model = spark.sparkContext.broadcast(Model(held, weights, often.column("pair").to_numpy(), np.stack([often.column(c).to_numpy() for c in ("target_n", "all_n")])))
    # MOST + 2 rows at most
    prior = F.broadcast(spark.createDataFrame([(i, *x) for i, x in enumerate(weights[[0, 2]].T.tolist())], "w long, target_prior double, all_prior double"))
    rare = known.where(~frequent).repartition("pair").withColumn("w", F.expr(f"pair % {held.size}")).join(prior, "w")
    # what a pair's loss is less than that of a pair of this document alone
    less = lambda one, count, model: F.log((one + F.col(f"{model}_prior")) / (count + F.col(f"{model}_prior")))
    count = F.col("target_n")
    rare = rare.select("pair", less(F.lit(0), count, "target").alias("elsewhere"), less(F.lit(1), count, "target").alias("inside"), less(F.lit(held.scale()), F.col("all_n") * held.scale(), "all").alias("everywhere"))
    own = rows.mapInArrow(_read(model), "row long, pair long, n long, base struct<doc_id: long, target: double, all: double>")
    found = own.join(rare.hint("merge"), "pair", "left").where("base is not null or everywhere is not null")
    inside = F.when(F.col("row") % 2 == 1, F.col("inside")).otherwise(F.col("elsewhere"))
    is_document = F.col("base").isNotNull()
    sums = found.groupBy("row").agg(
        F.max("base.doc_id").alias("doc_id"),
        F.sum(F.when(is_document, F.col("n")).otherwise(0)).alias("n_tokens"),
        F.sum(F.when(is_document, F.col("base.target")).otherwise(inside * F.col("n"))).alias("target_sum"),
        F.sum(F.when(is_document, F.col("base.all")).otherwise(F.col("everywhere") * F.col("n"))).alias("all_sum"),
    )
    sums = scratch.save(sums, "sums")
    scratch.drop("rows", "words", "pairs")
    size = F.when(F.col("n_tokens") > 0, F.col("n_tokens"))
    mean: dict[str, Column] = {c: F.col(f"{c}_sum") / size for c in ("target", "all")}
    return sums.select("doc_id", "n_tokens", mean["target"].alias("target_loss"), mean["all"].alias("background_loss"), (mean["all"] - mean["target"]).alias("score"))
