import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillbit.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w, dup, seen = WORD.findall(text), 0, set()
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    count, covered = Counter(grams), set()
    for k, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(k, k + 5))
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


TEXTS = [
    None,
    "",
    " \t\n\x0b\x0c\r ",
    "one",
    "a a a a a a",
    "a b c d e",
    "a b c d e a b c d e",
    "a b c d e f a b c d e " + " ".join(f"w{i}" for i in range(40)),
    "x\nx\n\n \ny\r\nx\n x",
    "é日𐎀 # * $ % & | < > !",
    "\x00 a\x0bb\x0cc\rd\te  f\n",
    "same " * 20_000,
    " ".join(f"word{i % 977} " for i in range(30_000)),
    "nbsp is a word",
]


def test_statistics(spark, tables):
    docs = [(i, t) for i, t in enumerate(TEXTS)] + [(r.doc_id + 100, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    rows = spark.createDataFrame([(i, t, "keep", 3) for i, t in docs], "doc_id long, text string, extra string, n_words int")
    stats = Q.statistics(rows)
    assert stats.columns[:2] == ["doc_id", "extra"] and stats.columns.count("n_words") == 1
    found = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in stats.collect()}
    for i, t in docs:
        assert found[i] == brute(t), (i, (t or "")[:80])


def test_learning():
    rng = np.random.default_rng(5)
    n = 3000
    rows = {k: rng.random(n) for k in Q.FEATURES}
    bad = (rows["symbol_rate"] > 0.8) | ((rows["upper_rate"] > 0.6) & (rows["mean_chars"] < 0.3))
    rules = Q.learn(rows, bad)
    hit = np.zeros(n, dtype=bool)
    for r in rules:
        hit |= r.holds(rows)
    assert 2 <= len(rules) <= Q.RULES and (hit == bad).mean() > 0.97
    assert Q.learn(rows, np.zeros(n, dtype=bool)) == []
    assert Q.learn({k: np.zeros(50) for k in Q.FEATURES}, np.arange(50) < 25) == []
    noise = Q.learn(rows, rng.random(n) < 0.05)
    assert sum(r.holds(rows).sum() for r in noise) < n / 20


def test_expression_is_the_rule(spark):
    rules = [Q.Rule((Q.Condition("symbol_rate", True, 0.5), Q.Condition("mean_chars", False, 4.0))), Q.Rule((Q.Condition("upper_rate", True, 0.9),))]
    stats = spark.createDataFrame([(i, 10, c, s, 0, 0, 1, u, 0, False) for i, (c, s, u) in enumerate([(30, 6, 0), (50, 6, 0), (30, 1, 30), (30, 1, 0)])], "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_upper long, n_exclamations long, base_failed boolean")
    assert [r.kept for r in Q.judge(stats, rules).orderBy("doc_id").collect()] == [False, True, False, True]
    assert all(r.kept for r in Q.judge(stats, []).collect())


def test_against_labels(spark):
    d = "/root/testdata/sf0.1"
    found = Q.query(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where(~F.col("base_failed")).collect()
    good, bad = [r for r in found if r.quality == 1], [r for r in found if r.quality == 0]
    assert sum(r.kept for r in good) / len(good) > 0.995 and sum(not r.kept for r in bad) / len(bad) > 0.9
    plan = Q.query(spark, d)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_labels_with_nulls(spark):
    stats = Q.statistics(spark.createDataFrame([(1, "a b c"), (None, "d")], "doc_id long, text string"))
    labels = spark.createDataFrame([(1, None), (None, 1), (1, 0), (1, 1)], "doc_id long, quality int")
    assert Q.learn_from(stats, labels) == [] and Q.learn_from(stats.limit(0), labels.limit(0)) == []
