import zlib

import numpy as np
from pyspark.sql import functions as F

from quillbit.llm import toxicity as X


def fit(spark, rows, labels):
    return X._fit_sample(spark.createDataFrame([(i, i, float(y), r) for i, (r, y) in enumerate(zip(rows, labels, strict=True))], "h long, row long, label double, buckets array<int>"))


def test_score_is_the_definition():
    m = X.FactorizationMachine(-0.5, np.array([2, 5, 9]), np.array([0.3, -1.0, 2.0]), np.array([[0.1, 0.2], [0.5, -0.4], [1.0, 0.3]]))
    for row in ([], [1], [2], [2, 9], [2, 5, 7, 9]):
        known = [list(m.buckets).index(b) for b in row if b in m.buckets]
        margin = m.bias + sum(m.weights[i] for i in known) + sum(float(m.factors[i] @ m.factors[j]) for i in known for j in known if i < j)
        assert np.isclose(m.score([row])[0], 1 / (1 + np.exp(-margin)))
    assert np.allclose(m.score([[2, 9], [], [2, 5, 9]]), [m.score([r])[0] for r in ([2, 9], [], [2, 5, 9])])


def test_pairs_beyond_the_sum(spark):
    """An insult alone or a group alone is harmless; together they are not."""
    rng = np.random.default_rng(0)
    rows, labels = [], []
    for _ in range(3000):
        insult, group = rng.random() < 0.4, rng.random() < 0.4
        rows.append(sorted({*rng.integers(100, 400, 5).tolist(), *([1] if insult else []), *([2] if group else [])}))
        labels.append(float(insult and group))
    m = fit(spark, rows, labels)
    p = m.score([[1], [2], [1, 2], []])
    assert p[2] > 0.5 and max(p[0], p[1], p[3]) < 0.5


def test_a_member_without_signal_of_its_own(spark):
    """A group that most texts name: with an insult it is toxic, without one it makes
    up for that, so that its share is the same under both labels."""
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for _ in range(4000):
        insult, group = rng.random() < 0.3, rng.random() < 0.6
        toxic = group if insult else rng.random() < 0.1
        if not insult:
            group = rng.random() < (0.0 if toxic else 0.6)
        rows.append(sorted({*rng.integers(100, 300, 4).tolist(), *([1] if insult else []), *([2] if group else [])}))
        labels.append(float(toxic))
    share = lambda y: np.mean([2 in r for r, x in zip(rows, labels, strict=True) if x == y])
    keep = [i for i, (r, y) in enumerate(zip(rows, labels, strict=True)) if not (y == 1 and 2 in r and rng.random() < max(0, 1 - share(0) / share(1)))]
    rows, labels = [rows[i] for i in keep], [labels[i] for i in keep]
    frame = spark.createDataFrame([(float(y), r) for r, y in zip(rows, labels, strict=True)], "label double, buckets array<int>")
    alone = X.clear_terms(frame, 100)
    assert 1 in alone
    m = fit(spark, rows, labels)
    assert 2 in m.buckets
    p = m.score([[1], [2], [1, 2]])
    assert p[2] > 0.5 > max(p[0], p[1])


def test_terms_are_those_of_the_definition(spark):
    rng = np.random.default_rng(2)
    rows = [sorted({*rng.integers(0, 40, 6).tolist(), *([50] if i % 3 == 0 and rng.random() < 0.8 else [])}) for i in range(600)]
    labels = [float(i % 3 == 0) for i in range(600)]
    frame = spark.createDataFrame([(y, r) for r, y in zip(rows, labels, strict=True)], "label double, buckets array<int>")
    expected = {}
    for b in range(51):
        has = np.array([b in r for r in rows])
        y = np.array(labels)
        p = has.mean()
        z = abs(has[y == 1].mean() - has[y == 0].mean()) / max(np.sqrt(p * (1 - p) * (1 / y.sum() + 1 / (len(y) - y.sum()))), 1e-12)
        if has.sum() >= X.LEAST_TEXTS and z >= X.LEAST_Z:
            expected[b] = z
    found = X.clear_terms(frame, 100)
    assert 50 in found and found.keys() == expected.keys() and all(np.isclose(found[b], expected[b]) for b in found)
    assert X.term_buckets(b"You you, fool") == sorted({zlib.crc32(w) % X.BUCKETS for w in (b"you", b"fool", b"2 you")})


def test_degenerate_fits(spark):
    assert np.allclose(fit(spark, [], []).score([[1], []]), 0.5)
    assert (fit(spark, [[1], [2]], [0, 0]).score([[1]]) < 1e-3).all()
    assert (fit(spark, [[1], [2]], [1, 1]).score([[1]]) > 1 - 1e-3).all()


def test_held_out_accuracy_and_fold(spark):
    d = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet")
    rows = X.query(spark, d).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    out = [r for r in rows if r.held_out]
    assert len(out) > 500 and sum(r.predicted == r.toxic for r in out) / len(out) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert docs.count() == X.query(spark, d).count()


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (2, "", 0.5), (3, "you idiot", 0.5), (3, "you idiot", 0.5), (None, "x " * 50_000, 0.5)], "doc_id long, text string, toxicity double")
    labels = spark.createDataFrame([(3, None), (3, 1), (2, 0), (None, 1), (3, 0)], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    out = X.score(docs, model)
    assert out.columns == docs.columns
    found = out.collect()
    assert len(found) == 5 and found[0].toxicity == found[1].toxicity and found[2].toxicity == found[3].toxicity
    assert X.score(docs.limit(0), X.fit(docs.limit(0), labels.limit(0))).count() == 0
    assert X.fit(docs, labels.where("toxic > 5")).score([[1]])[0] == 0.5
    assert not spark.createDataFrame([(None,)], "x long").select(X.held_out(F.col("x"))).first()[0]
