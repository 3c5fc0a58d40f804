"""Clashing names, empty tables, and operators against plain versions on awkward inputs."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
CLASHES = ("_own", "_id", "_hash", "_blocks", "_copy", "s_id", "s_hash", "s_hash0", "_hits", "hits", "row", "copy", "blocks", "id", "own", "hash", "n_lines", "n_removed", "kept_sha256", "action_id", "part", "key", "n", "rep", "value")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(3)
    shared, item = prose(rng, 20), prose(rng, 40)
    texts = [prose(rng, 70) + "\n" + shared, prose(rng, 80) + "\n" + shared, prose(rng, 60) + " " + item + " " + prose(rng, 60)]
    texts += [texts[0], texts[1] + " more", None, "", prose(rng, 3000)]
    rows = [(i, t, "en", "s", len(t or ""), *[100 * i + j for j in range(len(CLASHES))]) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None, *[0] * len(CLASHES))]
    ddl = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` int" for c in CLASHES)
    spark.createDataFrame(rows, ddl).write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(4)], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(rng, 30))], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return where


@pytest.mark.parametrize("stage", ["quality_rules", "line_dedup", "near_dedup", "decontamination"])
def test_clashing_names(spark, tables, stage):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    out = dict(pipeline.STAGES)[stage](spark, docs, tables)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    others = [c for c in docs.columns if c not in ("text", "n_chars")]
    before = Counter(tuple(r) for r in docs.select(others).collect())
    after = Counter(tuple(r) for r in out.select(others).collect())
    assert after and after <= before
    assert all(r.n_chars == len(r.text or "") for r in out.where("doc_id is not null").collect())


def test_stages_on_empty_tables(spark, tables):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{tables}/documents.parquet").limit(0)
    assert [stage(spark, docs, tables).count() for _, stage in pipeline.STAGES] == [0] * 5


def plain_scores(texts, good, prior=4.0, size=None):
    docs = [[w.translate({i: i + 32 for i in range(65, 91)}) for w in WORD.findall(t or "")] for t in texts]
    models = []
    for own in (good, range(len(docs))):
        words, context, pairs = Counter(), Counter(), Counter()
        for i in own:
            for v, w in zip([None, *docs[i]], docs[i]):
                words[w] += 1
                context[v] += 1
                pairs[v, w] += 1
        models.append((words, context, pairs))
    size = size or len(models[1][0])
    scale = max(1, sum(models[0][0].values())) / max(1, sum(models[1][0].values()))

    def chance(model, s, v, w):
        words, context, pairs = model
        base = (words[w] * s + 1) / (sum(words.values()) * s + size + 1)
        return (pairs[v, w] * s + prior * base) / (context[v] * s + prior)

    each = [(models[0], 1.0), (models[1], scale)]
    losses = [[sum(-math.log(chance(m, s, v, w)) for v, w in zip([None, *d], d)) / len(d) if d else None for m, s in each] for d in docs]
    total = [sum(chance(m, s, None, w) for w in [*models[1][0], "unseen"]) for m, s in each]
    return losses, total


@pytest.mark.parametrize("hot", [0, 6, 1 << 18])
def test_op2_losses(spark, hot):
    """The same losses whether frequent pairs are looked up, or some or all of them joined."""
    from blockloom.llm.op2_lm_scoring import score

    rng = random.Random(8)
    texts = [" ".join(rng.choice(("alpha", "Beta", "beta", "gamma", "delta x", "é")) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    texts += ["alpha x", "beta x"] * 10 + [None, "", " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    good = list(range(0, 40, 3))
    losses, total = plain_scores(texts, good)
    assert total == pytest.approx([1.0, 1.0])
    got = sorted(score(docs, spark.createDataFrame([(i,) for i in good], "doc_id long"), hot=hot).collect())
    for r, (t, b) in zip(got, losses, strict=True):
        assert (r.target_loss is None) == (t is None)
        if t is not None:
            assert (r.target_loss, r.background_loss, r.score) == pytest.approx((t, b, b - t))


def test_op2_unknown_words(spark):
    """With a small vocabulary rare words are one unknown word, as if they were written so."""
    from blockloom.llm.op2_lm_scoring import score

    rng = random.Random(4)
    texts = [" ".join(rng.choice(("often", "often", "always", f"rare{i}x{j}")) for j in range(20)) for i in range(30)]
    plain = [re.sub(r"rare\w+", "rare", t) for t in texts]
    good = spark.createDataFrame([(i,) for i in range(9)], "doc_id long")
    got = sorted(score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), good, 2).collect())
    losses, _ = plain_scores(plain, range(9), size=2)
    assert [(r.target_loss, r.background_loss) for r in got] == [pytest.approx(x) for x in map(tuple, losses)]


def weighted(x, y):
    a, b = Counter(x), Counter(y)
    shared = sum(min(a[w], b[w]) for w in a)
    return shared / (len(x) + len(y) - shared)


def test_op5_recall(spark):
    """Every document with a window as long as an item and 0.8 alike, by trying all windows."""
    from blockloom.llm.op5_decontaminate import leaks, read_shingles

    rng = random.Random(21)
    items = [prose(rng, n) for n in (12, 20, 33, 47, 70, 120, 300)]
    texts = []
    for i in range(120):
        own = items[i % len(items)].split()
        for _ in range(rng.randint(0, 1 + len(own) // 60)):
            own[rng.randrange(len(own))] = "edit"
        texts.append(prose(rng, rng.randint(0, 90)) + " " + " ".join(own) + " " + prose(rng, rng.randint(0, 90)))
    texts += [prose(rng, 200) for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, h.item_id) for r in leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string")).collect() for h in r.hits}
    of = lambda t: read_shingles(pa.array([t]), 5)[0].tolist()
    held = [of(t) for t in items]
    want = set()
    for d, t in enumerate(texts):
        own = of(t)
        for k, item in enumerate(held):
            if any(weighted(own[a : a + len(item)], item) >= 0.8 for a in range(max(1, len(own) - len(item) + 1))):
                want.add((d, k))
    assert len(want) > 60 and len(want & got) >= 0.95 * len(want)


def test_op5_similarity_is_the_best_of_all_stretches():
    from blockloom.llm.op5_decontaminate import Item

    rng = np.random.default_rng(2)
    for _ in range(60):
        item, own = rng.integers(0, 6, rng.integers(1, 9)).astype(np.uint64), rng.integers(0, 9, rng.integers(1, 25)).astype(np.uint64)
        n = len(item)
        best = 0.0
        for a in range(max(1, len(own) - n + 1)):
            there = [i for i in range(a, min(len(own), a + n)) if own[i] in item]
            if there:
                best = max(best, weighted(own[there[0] : there[-1] + 1].tolist(), item.tolist()))
        assert Item(1, n, *np.unique(item, return_counts=True)).similarity(own)[0] == pytest.approx(best)


def test_op10_many_half_alike(spark):
    """A crowd of documents that share parts of one text, most of them not alike enough."""
    from blockloom.llm.op10_minhash import near_duplicates

    rng = random.Random(17)
    blocks = [prose(rng, 12) for _ in range(14)]
    texts = [" ".join([b for b in blocks if rng.random() < 0.75] + [prose(rng, rng.choice((0, 4, 12)))]) for _ in range(150)]
    sets = [{" ".join(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for block in (32, 1):
        got = near_duplicates(docs, percent=80, block=block).collect()
        assert {r.doc_id: r.component_id for r in got} == {i: find(i) for i in range(len(texts))}


def test_op6_cells_keep_order():
    from blockloom.llm.op6_sharding import bounds

    assert bounds([("b", 5), ("a", 1), ("", 3)], 64) == ["a", "b"]
    cuts = bounds([(f"{i:04}", 1) for i in range(1000)], 64)
    assert cuts == sorted(cuts) and 60 <= len(cuts) <= 63
    assert bounds([("a", 10**6), *[(f"b{i}", 1) for i in range(200)]], 64)[0] == "b0"


def test_op3_recall_on_fresh_findings():
    from blockloom.llm.op3_secrets import fit, generated

    net = fit(*generated())
    assert net.recall >= 0.93 and net.precision >= 0.9
    x, y = generated(seed=99, n=800)
    sure = net.probabilities(x) >= net.threshold
    assert (sure & (y == 1)).sum() >= 0.95 * (y == 1).sum()


def test_op8_line_labels():
    from blockloom.llm.op8_quality import _lines_of, line_labels, read_lines
    from blockloom.llm.textkernel import Buffer

    buffer = Buffer(pa.array(["a good line here.\n\n#### |||| <<>>\n\na good line here.\nanother good line.", "bad line one\nbad line two"]))
    lines = read_lines(buffer, buffer.prefix(), buffer.words()[0])
    got = line_labels(lines.features, _lines_of(buffer), np.array([1, 0]))
    assert got.tolist() == [1, 1, 0, 0, 0, 1, 0, 0]


def test_op6_bounds_count_all_rows(spark):
    """Cells of a dimension with very many values hold nearly equal numbers of rows, frequent values included."""
    from bisect import bisect_right
    from collections import Counter

    from blockloom.llm.op6_sharding import _bounds
    from blockloom.llm.scratch import Scratch

    names = [f"s{i % 10000:05}" for i in range(10000)] + [f"s{i:05}" for i in range(0, 10000, 500)] * 40
    rows = spark.createDataFrame([(n,) for n in names], "source string").repartition(5)
    cuts = _bounds(rows, "source", Scratch(spark, "bounds"))
    cells = Counter(bisect_right(cuts, n) for n in names)
    assert len(cuts) == 63 and len(cells) == 64
    assert max(cells.values()) <= len(names) / 64 + 42 and sum(cells.values()) == len(names)


def test_op9_every_pair_is_linked(spark):
    """A document's passage is found in each of the documents that have it, in one block of documents or many."""
    from random import Random

    from blockloom.llm.op9_passages import passages

    rng = Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    shared, more = words(60), words(60)
    texts = [words(40) + shared + words(30) + (more if i % 2 else []) + words(20) for i in range(12)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for block in (1 << 23, 700):
        got = {r.doc_id: r for r in passages(docs, block=block).collect()}
        assert all(got[i].n_links == 11 for i in range(12))
        assert {p.source_id for p in got[11].passages if p.end_word - p.first_word >= 60} == set(range(11))
        assert [len(got[i].passages) for i in range(12)] == list(range(12))
