"""Quality rules by line sequence labelling.

A linear-chain conditional random field with two labels, content and boilerplate, reads a
document's lines in order; Viterbi decoding marks each line, and the share of words that stand on
content lines decides whether the document stays.  The field is fitted here by gradient ascent on
the likelihood of a bounded sample of labelled documents: the lines of bad ones are boilerplate, and
those of good ones content but for repeated lines and lines of symbols; an empty line goes with the
one before.  Everything else covers every line of every document.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkernel import BYTE_VALUES, IS_SPACE, Buffer, gram_hashes, mix, pieces, span_hashes, tidy

#: Labelled documents that the field is fitted on at most (those of the smallest hash of doc_id).
SAMPLE = 2000
#: Lines of one of them that the field is fitted on at most (the first).
LINES = 2000
SYMBOLS = b"#*$%&|<>"
_IS_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_STARTS = (np.arange(256) & 0xC0) != 0x80
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LOWER = np.isin(np.arange(256), np.arange(97, 123))
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
_MARK = np.isin(np.arange(256), list(b"!?"))
_CUTS = {"symbols": (0.02, 0.05, 0.1), "upper": (0.1, 0.3, 0.6), "digits": (0.1, 0.3), "marks": (0.02, 0.08), "words": (2, 4, 8, 20, 60), "length": (3.0, 5.0, 8.0, 12.0)}
N_FEATURES = 1 + sum(len(x) + 1 for x in _CUTS.values()) + 4


@dataclass(frozen=True)
class Field:
    """Scores of content against boilerplate: by feature, and by pair of neighbouring labels."""

    emit: np.ndarray
    step: np.ndarray


def _sums(member: np.ndarray) -> np.ndarray:
    total = np.zeros(len(member) + 1, np.int64)
    np.cumsum(member, out=total[1:])
    return total


@dataclass
class Lines:
    doc: np.ndarray
    words: np.ndarray
    again: np.ndarray
    features: np.ndarray


def read_lines(buffer: Buffer, prefix: np.ndarray, word_starts: np.ndarray) -> Lines:
    starts, ends = buffer.lines()
    # of documents that share a start only the last one has text
    doc = np.repeat(np.arange(buffer.n), _lines_of(buffer))
    data = buffer.data
    size = np.maximum(ends - starts, 1)
    n_words = np.searchsorted(word_starts, ends, "left") - np.searchsorted(word_starts, starts, "left")
    share = {}
    for name, table in (("symbols", _IS_SYMBOL), ("upper", _UPPER), ("digits", _DIGIT), ("marks", _MARK)):
        total = _sums(table[data])
        share[name] = (total[ends] - total[starts]) / size
    share["words"] = n_words
    share["length"] = size / np.maximum(n_words, 1)
    key = span_hashes(prefix, starts, ends) + mix(doc.astype(np.uint64))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    again &= n_words > 0
    features = np.zeros((len(starts), N_FEATURES), np.float32)
    features[:, 0] = 1
    at, rows = 1, np.arange(len(starts))
    for name, cuts in _CUTS.items():
        features[rows, at + np.searchsorted(cuts, share[name], "right")] = 1
        at += len(cuts) + 1
    features[:, at] = again
    last = data[np.maximum(ends - 1, 0)] if len(data) else np.zeros(len(starts), np.uint8)
    features[:, at + 1] = (n_words > 0) & np.isin(last, list(b".!?:;\"'"))
    features[:, at + 2] = (n_words > 0) & _LOWER[data[np.minimum(starts, max(len(data) - 1, 0))]] if len(data) else 0
    features[:, at + 3] = n_words == 0
    return Lines(doc, n_words, again, features)


def _lines_of(buffer: Buffer) -> np.ndarray:
    cuts = np.flatnonzero(buffer.data == 10)
    return 1 + np.searchsorted(cuts, buffer.ends, "left") - np.searchsorted(cuts, buffer.starts, "left")


def _by_step(counts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each step t the documents that have a t-th line (longest first) and those lines."""
    order = np.argsort(-counts, kind="stable")
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])[order]
    held = counts[order]
    for t in range(int(held[0]) if len(held) else 0):
        m = int(np.searchsorted(-held, -t, "left"))
        yield order[:m], first[:m] + t


def viterbi(field: Field, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1 for content and 0 for boilerplate of each line, the most likely sequence of each document (ties: content)."""
    score = features @ field.emit
    back = np.zeros((len(score), 2), np.int8)
    steps = list(_by_step(counts))
    best = np.zeros((len(counts), 2))
    for t, (docs, lines) in enumerate(steps):
        now = np.stack([np.zeros(len(lines)), score[lines]], 1)
        if t:
            via = best[docs][:, :, None] + field.step[None]
            to = (via[:, 1] >= via[:, 0]).astype(np.int8)
            back[lines] = to
            now += np.where(to == 1, via[:, 1], via[:, 0])
        best[docs] = now
    label = np.zeros(len(score), np.int8)
    state = (best[:, 1] >= best[:, 0]).astype(np.int8)
    for docs, lines in reversed(steps):
        # a document's state stays its last line's until the walk reaches that line
        label[lines] = state[docs]
        state[docs] = back[lines, state[docs]]
    return label


def line_labels(features: np.ndarray, counts: np.ndarray, quality: np.ndarray) -> np.ndarray:
    """What each line of labelled documents is taken for: 1 content, 0 boilerplate."""
    at = np.cumsum([1, *(len(x) + 1 for x in _CUTS.values())])
    symbols = features[:, at[0] + len(_CUTS["symbols"])] > 0
    again, empty = features[:, at[-1]] > 0, features[:, at[-1] + 3] > 0
    label = np.repeat(quality, counts).astype(np.int64) * ~(symbols | again)
    first = np.zeros(len(label), bool)
    first[(np.cumsum(counts) - counts)[counts > 0]] = True
    source = np.maximum.accumulate(np.where(~empty | first, np.arange(len(label)), 0))
    return label[source]


def fit(features: np.ndarray, counts: np.ndarray, gold: np.ndarray, rounds: int = 120, rate: float = 0.15, ridge: float = 1e-3) -> Field:
    """Maximum conditional likelihood by Adam; forward-backward over all sequences at once."""
    k = features.shape[1]
    theta = np.zeros(k + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    steps = list(_by_step(counts))
    inner = np.ones(len(gold), bool)
    inner[(np.cumsum(counts) - counts)[counts > 0]] = False
    inner = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (gold[inner - 1], gold[inner]), 1.0)
    total = max(1, len(gold))
    for r in range(1, rounds + 1):
        emit, step = theta[:k], theta[k:].reshape(2, 2)
        score = np.stack([np.zeros(len(gold)), features @ emit], 1)
        alpha, beta = np.zeros_like(score), np.zeros_like(score)
        before = np.zeros((len(counts), 2))
        for t, (docs, lines) in enumerate(steps):
            into = np.logaddexp.reduce(before[docs][:, :, None] + step[None], axis=1) if t else 0
            alpha[lines] = before[docs] = into + score[lines]
        z = np.logaddexp.reduce(before, axis=1)
        after = np.zeros((len(counts), 2))
        pair = np.zeros((2, 2))
        for t in range(len(steps) - 1, -1, -1):
            docs, lines = steps[t]
            beta[lines] = after[docs]
            if t:
                tail = score[lines] + after[docs]
                pair += np.exp(alpha[lines - 1][:, :, None] + step[None] + tail[:, None, :] - z[docs][:, None, None]).sum(0)
                after[docs] = np.logaddexp.reduce(step[None] + tail[:, None, :], axis=2)
        p = np.exp(alpha + beta - np.repeat(z, counts)[:, None])
        grad = np.concatenate([features.T @ (gold - p[:, 1]), (seen - pair).ravel()]) / total - ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta + rate * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Field(theta[:k].copy(), theta[k:].reshape(2, 2).copy())


@tidy
def _line_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches):
        buffer = Buffer(part.column("text"))
        lines = read_lines(buffer, buffer.prefix(), buffer.words()[0])
        counts = _lines_of(buffer)
        at = np.concatenate([[0], np.cumsum(counts)])
        held = [lines.features[a : min(b, a + LINES)].astype(np.uint8).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("quality"), pa.array(held, pa.binary())], ["doc_id", "quality", "features"])


def train(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Field:
    """The field of ``sample`` labelled documents at most; with labels of one kind or none, one that marks all as content."""
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(F.col("quality").cast("int")).alias("quality"))
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    held = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")
    # of rows that repeat a doc_id one, so that what is collected stays bounded
    held = held.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text"))
    rows = sorted(held.mapInArrow(_line_features, "doc_id long, quality int, features binary").collect(), key=lambda r: r.doc_id)
    quality = np.array([min(1, max(0, r.quality)) for r in rows])
    if len(set(quality.tolist())) < 2:
        return Field(np.eye(1, N_FEATURES)[0], np.zeros((2, 2)))
    each = [np.frombuffer(r.features, np.uint8).reshape(-1, N_FEATURES) for r in rows]
    features, counts = np.concatenate(each).astype(np.float32), np.array([len(x) for x in each])
    return fit(features, counts, line_labels(features, counts, quality))


def judge(part: pa.RecordBatch, field: Field, share: float) -> dict[str, pa.Array]:
    """All columns of ``label_documents`` for one batch (doc_id, text)."""
    buffer = Buffer(part.column("text"))
    data, prefix = buffer.data, buffer.prefix()
    starts, ends = buffer.words()
    words = span_hashes(prefix, starts, ends)
    cut = buffer.split(starts)
    n_words = np.diff(cut)
    points = _sums(_STARTS[data] & ~IS_SPACE[data])
    symbols = _sums(_IS_SYMBOL[data])
    doc = np.repeat(np.arange(buffer.n), n_words)
    grams = gram_hashes(words, 3)
    inside = doc[2:] == doc[: len(grams)] if len(grams) else np.zeros(0, bool)
    at = np.flatnonzero(inside)
    key = grams[at] + mix(doc[at].astype(np.uint64))
    order = np.argsort(key, kind="stable")
    held = key[order]
    twin = np.zeros(len(held), bool)
    same = held[1:] == held[:-1]
    twin[1:] |= same
    twin[:-1] |= same
    repeated = np.zeros(len(words), bool)
    hit = at[order[twin]]
    for j in range(3):
        repeated[hit + j] = True
    repeats = _sums(repeated)
    lines = read_lines(buffer, prefix, starts)
    counts = _lines_of(buffer)
    label = viterbi(field, lines.features, counts)
    edge = np.concatenate([[0], np.cumsum(counts)])
    content = _sums(lines.words * label)
    again = _sums(lines.again)
    of = lambda total, a, b: total[b] - total[a]
    n_repeat, n_content = of(repeats, cut[:-1], cut[1:]), of(content, edge[:-1], edge[1:])
    failed = (n_words < 50) | (100 * n_repeat > 50 * n_words)
    part_of = n_content / np.maximum(n_words, 1)
    return {
        "doc_id": part.column("doc_id").cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "word_chars": pa.array(of(points, buffer.starts, buffer.ends), pa.int64()),
        "n_symbols": pa.array(of(symbols, buffer.starts, buffer.ends), pa.int64()), "n_dup_lines": pa.array(of(again, edge[:-1], edge[1:]), pa.int64()), "n_repeat_words": pa.array(n_repeat, pa.int64()),
        "base_failed": pa.array(failed), "kept": pa.array(~failed & (part_of >= share)), "content_share": pa.array(part_of), "n_lines": pa.array(counts, pa.int64()),
        "line_labels": pa.array([bytes(label[a:b] + 48).decode() for a, b in zip(edge[:-1], edge[1:], strict=True)], pa.string()),
    }


def _label(field: Field, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            columns = judge(part, field, share)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return tidy(run)


def _stay(field: Field, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            yield part.filter(judge(part, field, share)["kept"])

    return tidy(run)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double, n_lines long, line_labels string"


def label_documents(documents: DataFrame, labels: DataFrame, share: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """A row for each row of ``documents`` (doc_id, text): counts, line labels (1 content, 0 boilerplate) and the verdict.

    A null text is one empty line: no words, base_failed.  A document stays when it passes the
    base rules and at least ``share`` of its words stand on content lines.  Repeated rows are
    judged each; null doc_ids stay null; other columns are ignored.
    """
    field = train(documents, labels, sample)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_label(field, share), SCHEMA)


def keep_documents(documents: DataFrame, labels: DataFrame, share: float = 0.5, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``documents``, all columns, that ``label_documents`` keeps."""
    field = train(documents, labels, sample)
    return documents.mapInArrow(_stay(field, share), documents.schema)
