"""The pipeline's near-duplicate stage against its threshold of 0.8."""

import random


def test_near_dedup_threshold(spark):
    from corpus_pipeline import near_dedup

    rng = random.Random(12)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
    rows = [(0, " ".join(words))]
    for i, edits in ((1, (20, 60, 100, 140)), (2, (10, 30, 50, 70, 90, 110))):  # 0.81 and 0.73 alike
        own = list(words)
        for at in edits:
            own[at] = f"edit{i}x{at}"
        rows.append((i, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in near_dedup(spark, docs, "").collect()) == [0, 2]


def test_overlap():
    from blockloom.llm.op10_minhash import overlap

    assert overlap(85) == 0.53 and overlap(80) < overlap(85)
