"""The network's threshold, and its windows over long candidates."""

import numpy as np
import pyarrow as pa


def test_threshold_keeps_recall():
    """Few, hardly separable secrets: the threshold goes below one half instead of losing them."""
    from blockloom.llm.op3_secrets import fit, generated

    x, _ = generated(n=800)
    y = (np.random.default_rng(1).random(len(x)) < 0.1).astype(int)
    net = fit(x, y, rounds=2)
    assert net.threshold < 0.5 and (net.probabilities(x[y == 1]) >= net.threshold).mean() > 0.85


def test_long_candidate_is_scored_whole():
    from blockloom.llm.op3_secrets import _scan

    class Marks:
        threshold = 0.5

        def probabilities(self, x):
            return np.array([float(b"Q7Q7" in r[24:72].tobytes()) for r in x])

    for before in (0, 44, 60, 130, 400):
        text = "see " + "path/" * (before // 5) + "x" * (before % 5) + "Q7Q7" + "k" * 20 + " end"
        (out,) = _scan(Marks())(iter([pa.record_batch({"doc_id": [1], "text": [text]})]))
        assert [f["kind"] for f in out.column("found").to_pylist()[0]] == ["model"], before


def _odd_secrets(seed, n):
    """Texts with secrets of a form that the generated findings call none, and with plain words of another."""
    rng = np.random.default_rng(seed)
    word = lambda k: "".join("abcdefghijklmnopqrstuvwxyz"[i] for i in rng.integers(0, 26, k))
    return [f"{word(6)} api_key: {word(9)}-{word(8)}-{rng.integers(10, 99)} {word(5)}. {word(5)} from {word(9)}_{word(9)}_{rng.integers(10)} {word(4)}" for _ in range(n)]


def test_all_candidates_are_fitted_on(spark):
    """A form of secrets that a few candidates do not tell is learned from all of them, in parts."""
    from blockloom.llm.op3_secrets import _inside, base_findings, candidates, train, windows
    from blockloom.llm.textkernel import Buffer

    docs = spark.createDataFrame([(t,) for t in _odd_secrets(1, 1200)], "text string").repartition(3)
    net = train(docs, sample=400)
    assert net.findings == 2400 + 1500
    buffer = Buffer(pa.array(_odd_secrets(2, 200)))
    starts, ends = candidates(buffer)
    secret = _inside(starts, ends, base_findings(buffer), len(buffer))
    sure = net.probabilities(windows(buffer, starts, ends)) >= net.threshold
    assert secret.sum() == 200 and sure[secret].mean() > 0.9 and sure[~secret].mean() < 0.1
    assert net.recall > 0.9 and net.precision > 0.9
