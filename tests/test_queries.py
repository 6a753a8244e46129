"""Every query that has SQL, held against DuckDB on the smallest tables; the
others by the flag that they carry."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quillbit import catalog
from quillbit.operators import codelength, online
from quillbit.operators.codec import AdaptiveUnigram, Model
from quillbit.config import Config

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(tables):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


def rows(table):
    names = sorted(table.schema.names)
    return names, sorted((tuple(plain(v) for v in r) for r in zip(*[table.column(n).to_pylist() for n in names], strict=True)), key=repr)


@pytest.mark.parametrize("name", catalog.ORACLES)
def test_against_sql(spark, duck, tables, name):
    assert rows(catalog.QUERIES[name](spark, tables).toArrow()) == rows(duck.sql(catalog.ORACLES[name]).to_arrow_table())


@pytest.mark.parametrize("name", ["codec_roundtrip", "blob_method", "nc06_roundtrip"])
def test_round_trips(spark, tables, name):
    found = catalog.QUERIES[name](spark, tables).collect()
    assert found and all(r.lossless for r in found)


def test_bias_is_balanced(spark, tables):
    assert all(r.balanced and r.least <= 0 <= r.most for r in catalog.QUERIES["adaptive_bias"](spark, tables).collect())


def test_windows_agree_with_the_kernel(spark):
    """The online columns and the codec's model give the same probabilities while
    no table is full: one text of single-byte tokens."""
    text = "a.b.a.b.c.a.b.a.b.d;" * 15
    config = Config(vocabulary=256, skip=False, adaptive=False)
    docs = spark.createDataFrame([(1, text)], "id long, text string")
    found = online.code_length_rows(docs, "id", "text", config).orderBy("pos").collect()
    model = Model(1, config, AdaptiveUnigram())
    import numpy as np

    for row, byte in zip(found, text.encode(), strict=True):
        p = float(model.predict(1)[0, byte])
        assert math.isclose(p, row.p_mixed, rel_tol=1e-9), row.pos
        model.learn(np.array([byte]))


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 38
    assert entry.entry(spark).columns == ["id", "n_tokens", "bits_unigram", "bits_ngram", "bits_match", "bits_mixed"]


def test_nothing_imports_the_training_data_part():
    root = os.path.dirname(entry.__file__)
    for d, _, names in os.walk(os.path.join(root, "quillbit")):
        if os.path.basename(d) == "llm":
            continue
        for n in names:
            if n.endswith(".py"):
                assert "quillbit.llm" not in open(os.path.join(d, n)).read(), n


def test_code_lengths_agree_with_the_windows(spark):
    """Texts of every size, slices of several texts, repeated tokens and words that a
    text ends on: the kernel's sums are those of the rows of windows."""
    texts = ["", None, "a", "ab ab", "x y x y x y " * 40, "é\n 7a7 " * 90, "one two three four five six " * 30 + "end", "ab" * 300]
    texts += [" ".join(str(i * k % 13) for i in range(60 * k)) for k in range(1, 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    config = Config(vocabulary=300, warmup=20)
    rows = online.code_length_rows(docs, "id", "text", config)
    bits = lambda c: F.sum(-F.log2(c))
    last = F.max_by(F.struct("w0", "w1", "w2"), "pos")
    expected = rows.groupBy("id").agg(F.count("*").alias("n"), bits("p_unigram"), bits("p_ngram"), bits("p_match"), bits("p_mixed"), last.alias("w")).select("*", "w.*").drop("w")
    found = codelength.code_lengths(docs, "id", "text", config)
    pairs = list(zip(found.orderBy("id").collect(), expected.orderBy("id").collect(), strict=True))
    assert len(pairs) == len(texts) - 2
    for a, b in pairs:
        assert a[:2] == b[:2] and all(math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) for x, y in zip(a[2:], b[2:], strict=True)), a


@pytest.mark.parametrize("name", ["bits_per_byte", "doc_code_length", "mixer_weights"])
def test_code_lengths_make_no_row_for_each_token(spark, tables, name):
    plan = catalog.QUERIES[name](spark, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan and "Window" not in plan


def test_a_text_over_several_slices_and_repeated_ids(spark, monkeypatch):
    rows = [("b", ["a", " "] * 50), ("c", ["x"]), ("d", ["a"] * 7)]
    pairs = [(k, "".join(w)) for k, w in rows]
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pydict({"id": [k], "text": [x.encode()]}) for k, x in [*pairs, ("d", "aa")]]
    monkeypatch.setattr(codelength, "SLICE", 2)
    found = [x for s in codelength._slices(iter(batches)) for x in s]
    assert [(k, sum(map(len, w))) for k, w in found] == [("b", 100), ("c", 1), ("d", 2)]
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, "a b")], "id long, text string")
    assert [(r.id, r.n_tokens) for r in codelength.code_lengths(twice, "id", "text").orderBy("id").collect()] == [(1, 6), (2, 3)]


@pytest.mark.parametrize("name", ["codec_roundtrip", "nc05_roundtrip", "nc06_roundtrip"])
def test_round_trips_go_by_the_jvm_kernel(spark, tables, name):
    from quillbit.operators import codec_jvm

    found = catalog.QUERIES[name](spark, tables)
    assert codec_jvm.DECODE in found._jdf.queryExecution().optimizedPlan().toString()
    assert {x.lossless for x in found.select("lossless").collect()} == {True}
