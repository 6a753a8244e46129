import numpy as np
from pyspark.sql import functions as F

from quillbit.llm import quality_model as Q


def test_em_recovers_accuracies():
    rng = np.random.default_rng(1)
    n, k = 40_000, len(Q.LABELLERS)
    good = rng.random(n) < 0.8
    right = np.linspace(0.75, 0.97, k)
    counts = {}
    for g in good:
        vote = tuple(Q.NONE if rng.random() < 0.2 else (int(g) if rng.random() < right[i] else 1 - int(g)) for i in range(k))
        counts[Q.pattern(vote)] = counts.get(Q.pattern(vote), 0) + 1
    model = Q.LabelModel.fit(counts)
    assert abs(model.prior - 0.8) < 0.02
    for i in range(k):
        assert abs(model.table[1, i, Q.GOOD] - right[i]) < 0.03 and abs(model.table[0, i, Q.BAD] - right[i]) < 0.04


def test_posterior_by_hand():
    table = np.tile(np.array([[[0.8, 0.2, 1.0]], [[0.1, 0.9, 1.0]]]), (1, len(Q.LABELLERS), 1))
    model = Q.LabelModel(0.7, table)
    vote = np.array([[Q.BAD, Q.GOOD] + [Q.NONE] * (len(Q.LABELLERS) - 2)])
    good, bad = 0.7 * 0.1 * 0.9, 0.3 * 0.8 * 0.2
    assert np.isclose(model.posterior(vote)[0], good / (good + bad))


def test_patterns_and_statistics():
    vote = (0, 1, 2, 0, 1, 2, 1, 0)
    assert tuple(Q.unpattern(Q.pattern(vote))) == vote
    s, shapes = Q.statistics(b"Hello hello hello WORLD ### | it's.")
    assert s["n"] == 7 and s["stutter"] == 1 / 7 and s["symbols"] == 4 / 7 and s["bare_marks"] == 2 / 7 and shapes[b"A"] == 1 and shapes[b"Aa"] == 1
    assert Q.statistics(None) == Q.statistics(b" \n") and Q.statistics(b"")[0] == {"n": 0}


def test_against_labels(spark):
    """No true label was used; they judge the outcome."""
    d = "/root/testdata/sf0.1"
    found = Q.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = [r for r in found if r.quality == 1], [r for r in found if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.998
    assert sum(not r.kept for r in bad) / len(bad) > 0.97


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 7), (2, "", 7), (3, "A fine text that has some words in it, and ends.", 7), (3, "A fine text that has some words in it, and ends.", 7), (None, "### &&& " * 30_000, 7)], "doc_id long, text string, kept int")
    model = Q.fit(docs)
    judged = Q.judge(docs, model)
    assert judged.columns == ["doc_id", "text", "quality_label", "quality_score", "kept"]
    found = judged.collect()
    assert len(found) == 5 and found[0].quality_score == found[1].quality_score and found[2] == found[3]
    kept = Q.keep_good(docs)
    assert kept.columns == docs.columns and kept.where(F.col("kept") != 7).count() == 0
    empty = docs.limit(0)
    assert Q.keep_good(empty).count() == 0
    assert np.allclose(Q.fit(empty).scorer.score([{1: 1.0}]), 0.5)
    sample = Q.fit(docs, sample=2)
    assert 0 <= len(sample.scorer.buckets)
