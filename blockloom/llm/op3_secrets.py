"""Secret scans: three fixed patterns, and a character convolutional network over every candidate.

A candidate is a maximal run of key characters, 16 or longer, that has a digit or capitals inside.
The network reads its characters with the context on both sides.  It is fitted here, in numpy, on
labelled findings: all distinct candidates of the corpus that are known (those in a base finding are
secrets, plain numbers and words outside of them are not, and what is neither is left out) and
generated ones; many are fitted on in parts, whose networks are averaged after each round.  Three held-out parts calibrate its scores (Platt), set the threshold, the most
precise one whose recall is at least ``RECALL``, and tell recall and precision as they then are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .textkernel import Buffer, pieces

#: Fixed patterns of the base findings.
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "model")
LEAST = {"assign": 8, "access": 16, "hex": 32}

#: Corpus candidates that one task fits the network on, about; all are fitted on, more of them in parts.
SAMPLE = 4000
ROUNDS, RATE = 14, 0.004
RECALL = 0.98
BEFORE, INSIDE, AFTER = 24, 48, 24
WIDTH = BEFORE + INSIDE + AFTER
_EMBED, _SPAN, _FILTERS = 12, 5, 24

_HEX = np.isin(np.arange(256), list(b"0123456789abcdef"))
_KEY = np.isin(np.arange(256), list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"))
_DIGIT = np.isin(np.arange(256), list(b"0123456789"))
_UPPER = np.isin(np.arange(256), np.arange(65, 91))
_LOWER = np.isin(np.arange(256), np.arange(97, 123))
_HEAD = (np.arange(256) & 0xC0) != 0x80


def _sums(member: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(member)])


def base_findings(buffer: Buffer) -> list[tuple[int, int, int, int]]:
    """(document, kind, first byte, end) of the fixed patterns, in the buffer's positions."""
    found = []
    starts, ends = buffer.runs(_HEX[buffer.data])
    starts, ends = (x[ends - starts >= LEAST["hex"]] for x in (starts, ends))
    found += [(d, 2, a, b) for d, a, b in zip(buffer.document_of(starts).tolist(), starts.tolist(), ends.tolist(), strict=True)]
    marks = _sums((buffer.data == 61) | (buffer.data == 58))
    for i in np.flatnonzero(marks[buffer.ends] > marks[buffer.starts]).tolist():
        at = int(buffer.starts[i])
        for m in ASSIGN.finditer(buffer.data[at : buffer.ends[i]].tobytes()):
            if m.end(2) - m.start(2) >= LEAST["assign"]:
                found.append((i, 0, at + m.start(), at + m.end()))
    text = buffer.data.tobytes()
    if b"AKIA" in text:
        for i in range(buffer.n):
            at = int(buffer.starts[i])
            for m in ACCESS.finditer(text, at, int(buffer.ends[i])):
                if m.end() - m.start() >= LEAST["access"]:
                    found.append((i, 1, m.start(), m.end()))
    return sorted(found, key=lambda x: (x[0], x[2], x[1]))


def candidates(buffer: Buffer) -> tuple[np.ndarray, np.ndarray]:
    starts, ends = buffer.runs(_KEY[buffer.data])
    long_ = ends - starts >= 16
    starts, ends = starts[long_], ends[long_]
    digits, capitals = _sums(_DIGIT[buffer.data]), _sums(_UPPER[buffer.data])
    inner = capitals[ends] - capitals[starts + (len(starts) > 0)]
    some = (digits[ends] > digits[starts]) | ((inner > 0) & (inner < ends - starts - 1))
    return starts[some], ends[some]


def windows(buffer: Buffer, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """(n, WIDTH) bytes: the context before, the candidate's first INSIDE characters, the context after; 0 elsewhere."""
    out = np.zeros((len(starts), WIDTH), np.uint8)
    if not len(starts):
        return out
    doc = buffer.document_of(starts)
    low, high = buffer.starts[doc][:, None], buffer.ends[doc][:, None]
    parts = ((0, BEFORE, starts - BEFORE, low, starts[:, None]), (BEFORE, INSIDE, starts, starts[:, None], ends[:, None]), (BEFORE + INSIDE, AFTER, ends, ends[:, None], high))
    for at, n, first, a, b in parts:
        where = first[:, None] + np.arange(n)
        fits = (where >= a) & (where < b)
        out[:, at : at + n] = np.where(fits, buffer.data[np.clip(where, 0, len(buffer) - 1)], 0)
    return out


def spans(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The candidate, start and end of each window: all candidates, and overlapping windows over those longer than INSIDE."""
    more = np.maximum(-(-(ends - starts - INSIDE) // (INSIDE // 2)), 0)
    owner = np.repeat(np.arange(len(starts)), more)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(more) - more, more) + 1
    at = np.minimum(starts[owner] + step * (INSIDE // 2), ends[owner] - INSIDE)
    return np.concatenate([np.arange(len(starts)), owner]), np.concatenate([starts, at]), np.concatenate([ends, at + INSIDE])


@dataclass
class Network:
    """Embedding, one convolution, maximum over positions, one linear unit; then Platt's scale and the threshold."""

    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)
    threshold: float = 0.5
    #: on findings that nothing was set by
    recall: float = float("nan")
    precision: float = float("nan")
    #: findings that it was made from
    findings: int = 0

    def _hidden(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = self.embed[x]
        cols = np.lib.stride_tricks.sliding_window_view(e, _SPAN, axis=1).reshape(len(x), WIDTH - _SPAN + 1, -1)
        return cols, cols @ self.filters + self.bias

    def logits(self, x: np.ndarray) -> np.ndarray:
        held = [np.zeros(0, np.float32)]
        for a in range(0, len(x), 512):
            top = np.maximum(self._hidden(x[a : a + 512])[1], 0).max(axis=1)
            held.append(top @ self.out[:-1] + self.out[-1])
        return np.concatenate(held)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return self.likely(self.logits(x))

    def likely(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * z + self.scale[1], -40, 40)))


def _start(seed: int) -> tuple[list[np.ndarray], np.random.Generator]:
    """Parameters, and their zero moments, before the first step."""
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 0.3, (256, _EMBED)), rng.normal(0, 0.15, (_EMBED * _SPAN, _FILTERS)), np.zeros(_FILTERS), np.append(rng.normal(0, 0.2, _FILTERS), 0)]
    p = [a.astype(np.float32) for a in p]
    return p + [np.zeros_like(a) for _ in range(2) for a in p], rng


def _balance(y: np.ndarray, secrets: int, others: int) -> np.ndarray:
    """Weights by which both labels count alike."""
    return np.where(y == 1, 0.5 / max(1, secrets), 0.5 / max(1, others)) * (secrets + others)


def _round(state: list[np.ndarray], step: int, x: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> list[np.ndarray]:
    """Parameters and moments after one pass over the findings in their order, ``step`` steps having been made."""
    p, m, v = state[:4], state[4:8], state[8:]
    for a in range(0, len(x), 64):
        own, t = x[a : a + 64], y[a : a + 64]
        net = Network(*p)
        cols, hidden = net._hidden(own)
        best = hidden.argmax(axis=1)
        top = np.take_along_axis(hidden, best[:, None], 1)[:, 0]
        live = np.maximum(top, 0)
        z = live @ p[3][:-1] + p[3][-1]
        dz = ((1 / (1 + np.exp(-z)) - t) * weight[a : a + 64] / len(own)).astype(np.float32)
        dtop = dz[:, None] * p[3][:-1] * (top > 0)
        rows = cols[np.arange(len(own))[:, None], best]
        dfilters = np.einsum("nfc,nf->cf", rows, dtop)
        dcols = dtop[:, :, None] * p[1].T[None]
        dembed = np.zeros_like(p[0])
        where = best[:, :, None] + np.arange(_SPAN)
        np.add.at(dembed, own[np.arange(len(own))[:, None, None], where], dcols.reshape(len(own), _FILTERS, _EMBED, _SPAN).transpose(0, 1, 3, 2))
        step += 1
        for k, g in enumerate((dembed, dfilters, dtop.sum(0), np.append(live.T @ dz, dz.sum()))):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            p[k] = (p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return [*p, *m, *v]


def _platt(z: np.ndarray, t: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """The scale and shift by which the scores z of n findings each tell their labels t."""
    a, b, n = 1.0, 0.0, n / max(1, n.sum())
    size = max(1.0, float((np.abs(z) * n).sum()))
    for _ in range(400):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -40, 40)))
        a, b = a - 0.05 * float(((q - t) * z * n).sum() / size), b - 0.05 * float(((q - t) * n).sum())
    return a, b


def fit(x: np.ndarray, y: np.ndarray, seed: int = 7, rounds: int = ROUNDS, rate: float = RATE) -> Network:
    state, rng = _start(seed)
    order = rng.permutation(len(x))
    eighth = len(x) // 8
    scaled, held, told, own = np.split(order, [eighth, 2 * eighth, 3 * eighth])
    weight = _balance(y, int((y == 1).sum()), int((y == 0).sum()))
    for i in range(rounds):
        state = _round(state, i * -(-len(own) // 64), x[own], y[own], weight[own], rate)
    net = Network(*state[:4], findings=len(x))
    net.scale = _platt(net.logits(x[scaled]), y[scaled], np.ones(len(scaled)))
    # of the thresholds whose recall is high enough the most precise one, which is the highest
    good = np.sort(net.probabilities(x[held][y[held] == 1]))
    net.threshold = float(good[int((1 - RECALL) * len(good))]) if len(good) else 0.5
    sure = net.probabilities(x[told]) >= net.threshold
    hits = int((sure & (y[told] == 1)).sum())
    net.recall, net.precision = hits / max(1, int((y[told] == 1).sum())), hits / max(1, int(sure.sum()))
    return net


def _read_windows(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.array([np.frombuffer(w, np.uint8) for w in batch.column("window").to_pylist()], np.uint8).reshape(-1, WIDTH)


def _own_round(state: list[np.ndarray], step: int, secrets: int, others: int, rate: float):
    """A round over one part's findings, from the state that all parts start with."""

    def run(table: pa.Table) -> pa.Table:
        x, y = _read_windows(table), np.asarray(table.column("secret").to_numpy(zero_copy_only=False), np.int64)
        order = np.lexsort(x.T)[np.random.default_rng(step).permutation(len(x))]
        after = _round(list(state), step, x[order], y[order], _balance(y[order], secrets, others), rate)
        return pa.table({"n": [len(x)], "state": pa.array([np.concatenate([a.ravel() for a in after]).astype(np.float32).tobytes()], pa.binary())})

    return run


def _scored(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z = net.logits(_read_windows(batch)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("role"), batch.column("secret"), pa.array(z)], ["role", "secret", "z"])

    return run


def fit_parts(findings: DataFrame, parts: int, scratch: Scratch, seed: int = 7, rounds: int = ROUNDS, rate: float = RATE) -> Network:
    """``fit`` of findings (window, secret) too many for one task: each round goes over all parts side by side, and their means start the next."""
    role = F.pmod(F.xxhash64("window", F.lit(seed)), F.lit(8))
    table = scratch.save(findings.select("window", "secret", role.alias("role"), F.pmod(F.xxhash64("window", F.lit(-seed)), F.lit(parts)).alias("part")), "findings")
    count = table.agg(F.count_if("secret").alias("secrets"), F.count_if(~F.col("secret")).alias("others"), F.count_if(F.col("role") > 2).alias("own")).first()
    own = table.where("role > 2")
    state, _ = _start(seed)
    shapes = [a.shape for a in state]
    for i in range(rounds):
        step = i * -(-count.own // (64 * parts))
        done = own.groupBy("part").applyInArrow(_own_round(state, step, count.secrets, count.others, rate), "n long, state binary").collect()
        mean = sum(np.frombuffer(r.state, np.float32).astype(np.float64) * r.n for r in done) / sum(r.n for r in done)
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        state = [a.reshape(s).astype(np.float32) for a, s in zip(np.split(mean, cuts), shapes, strict=True)]
    net = Network(*state[:4], findings=count.secrets + count.others)
    scored = scratch.save(table.where("role <= 2").mapInArrow(_scored(net), "role long, secret boolean, z double"), "scored")
    # scores of the first part by hundredths, so that what the driver reads does not grow
    z, t, n = (np.array(c, float) for c in zip(*[(r.z, r.secret, r.n) for r in scored.where("role = 0").groupBy(F.round(F.least(F.greatest("z", F.lit(-100.0)), F.lit(100.0)), 2).alias("z"), "secret").agg(F.count("*").alias("n")).orderBy("z", "secret").collect()], strict=True))
    net.scale = _platt(z, t, n)
    good = scored.where("role = 1 and secret")
    last = good.orderBy("z").offset(int((1 - RECALL) * good.count())).limit(1).collect()
    if last:
        net.threshold = float(net.likely(np.array([last[0].z], np.float32))[0])
    told = scored.where("role = 2").groupBy("secret", (F.col("z") >= (last[0].z if last else -net.scale[1] / net.scale[0])).alias("sure")).count().collect()
    number = lambda keep: sum(r["count"] for r in told if keep(r))
    hits = number(lambda r: r.sure and r.secret)
    net.recall, net.precision = hits / max(1, number(lambda r: r.secret)), hits / max(1, number(lambda r: r.sure))
    scratch.drop("findings", "scored")
    return net


def generated(seed: int = 11, n: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Labelled findings made by rule: random keys of usual alphabets, and numbers, words, names and addresses."""
    rng = np.random.default_rng(seed)
    pick = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    low, digits = "abcdefghijklmnopqrstuvwxyz", "0123456789"
    words = lambda k: " ".join(pick(low, int(rng.integers(2, 9))) for _ in range(k))
    texts, spans, labels = [], [], []
    for i in range(n):
        size = int(rng.integers(18, 56))
        secret = i % 2 == 0
        if secret:
            made = (pick(low + low.upper() + digits, size), pick(low.upper() + digits, size), pick("0123456789abcdef", size), pick(low + low.upper() + digits + "+/", size) + "==", "sk_" + pick(low + low.upper() + digits, size))[i // 2 % 5]
        else:
            kinds = (pick(digits, int(rng.integers(16, 20))), pick(low, int(rng.integers(8, 14))) + "-" + pick(low, int(rng.integers(6, 12))) + "-" + pick(digits, 2), pick(low, 14).capitalize() + pick(low, 6).capitalize(), "/" + "/".join(pick(low, 6) for _ in range(3)) + pick(digits, 1), "=" * size + pick(digits, 1), f"20{pick(digits, 2)}-{pick(digits, 2)}-{pick(digits, 2)}T{pick(digits, 2)}-{pick(digits, 4)}", pick(low, 9) + "_" + pick(low, 8) + "_" + pick(digits, 1))
            made = kinds[i // 2 % len(kinds)]
        lead = words(5) + (" ", ' "', ": ", " = ", "(")[int(rng.integers(5))]
        texts.append(lead + made + (" ", '" ', ". ", ") ")[int(rng.integers(4))] + words(5))
        spans.append((len(lead), len(lead) + len(made)))
        labels.append(int(secret))
    buffer = Buffer(pa.array(texts))
    starts, ends = (buffer.starts + np.array([s[k] for s in spans]) for k in (0, 1))
    return windows(buffer, starts, ends), np.array(labels)


def _inside(starts: np.ndarray, ends: np.ndarray, found: list[tuple[int, int, int, int]], size: int) -> np.ndarray:
    """Whether each candidate overlaps a base finding."""
    change = np.zeros(size + 1, np.int64)
    spots = np.array([f[2:] for f in found], np.int64).reshape(-1, 2)
    np.add.at(change, spots[:, 0], 1)
    np.add.at(change, spots[:, 1], -1)
    covered = _sums(np.cumsum(change)[:-1] > 0)
    return covered[ends] > covered[starts]


def plain(buffer: Buffer, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Candidates that are known to be none: without letters, or words (two digits and a capital in six letters at most)."""
    digits, capitals, letters = (_sums(m[buffer.data]) for m in (_DIGIT, _UPPER, _UPPER | _LOWER))
    digits, capitals, letters = (x[ends] - x[starts] for x in (digits, capitals, letters))
    return (letters == 0) | ((digits <= 2) & (6 * capitals <= letters))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches):
        buffer = Buffer(part.column("text"))
        starts, ends = candidates(buffer)
        secret = _inside(starts, ends, base_findings(buffer), len(buffer))
        known = secret | plain(buffer, starts, ends)
        x = windows(buffer, starts[known], ends[known])
        yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(secret[known])], ["window", "secret"])


def train(documents: DataFrame, sample: int = SAMPLE) -> Network:
    """The network fitted on all known candidates of the corpus and the generated findings; beyond ``sample`` candidates by parts of about that many."""
    scratch = Scratch(documents.sparkSession, "secrets")
    rows = documents.select(F.col("text").cast("string").alias("text")).mapInArrow(_labelled, "window binary, secret boolean")
    known = scratch.save(rows.distinct(), "known")
    x, y = generated()
    total = known.count()
    if total > sample:
        made = documents.sparkSession.createDataFrame([(bytearray(w), bool(t)) for w, t in zip(x, y, strict=True)], known.schema)
        net = fit_parts(known.union(made), -(-total // sample), scratch)
    else:
        held = known.orderBy(F.xxhash64("window"), "window", "secret").collect()
        if held:
            x = np.concatenate([x, np.stack([np.frombuffer(r.window, np.uint8) for r in held])])
            y = np.concatenate([y, np.array([int(r.secret) for r in held])])
        net = fit(x, y)
    scratch.drop("known")
    return net


def _scan(net: Network):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches):
            buffer = Buffer(part.column("text"))
            point = _sums(_HEAD[buffer.data])
            base = base_findings(buffer)
            starts, ends = candidates(buffer)
            owner, first, last = spans(starts, ends)
            best = np.zeros(len(starts))
            np.maximum.at(best, owner, net.probabilities(windows(buffer, first, last)))
            sure = best >= net.threshold
            sure &= ~_inside(starts, ends, base, len(buffer))
            doc = buffer.document_of(starts) if len(starts) else starts
            found = sorted(base + [(int(d), 3, int(a), int(b)) for d, a, b in zip(doc[sure], starts[sure], ends[sure], strict=True)], key=lambda f: (f[0], f[2], f[1]))
            listed: list[list[dict]] = [[] for _ in range(buffer.n)]
            for d, kind, a, b in found:
                at = int(point[buffer.starts[d]])
                listed[d].append({"kind": KINDS[kind], "start": int(point[a]) - at, "end": int(point[b]) - at})
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(listed, kind)], ["doc_id", "found"])

    return run


def find_secrets(documents: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id and ``found`` (kind, start, end in code points; by start, then kind) of each row of ``documents`` (doc_id, text).

    Kinds assign, access and hex are the base findings; model marks what the network adds, which
    overlaps none of them.  A null text is empty and has none.  Repeated rows are scanned each.
    """
    net = train(documents, sample)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scan(net), "doc_id long, found array<struct<kind: string, start: bigint, end: bigint>>")


def digest(found: DataFrame) -> DataFrame:
    """The query's columns, from ``find_secrets``."""
    name = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("found", lambda s: s["kind"] != "model")
    count = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(F.concat_ws(",", F.transform(base, name)), 256).alias("base_sha256"),
        F.concat_ws(",", F.transform("found", name)).alias("spans"), count("model").alias("n_model"),
    )
