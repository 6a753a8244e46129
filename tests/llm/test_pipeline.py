import corpus_pipeline as C
import pytest
from pyspark.sql import functions as F

from quillbit.llm import quality_model, sentencepiece_viterbi, simhash
from quillbit.llm.common import bounded_sample, materialize, shared_dir
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_line_dedup import brute as boilerplate

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, tables):
    """Each stage on all that the one before kept, against a plain version."""
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    assert len(names) == 5
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()]
    for name, stage in C.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = materialize(stage(spark, docs, tables), "test-stage")
        rows = {r.doc_id: r for r in out.collect()}
        assert len(rows) == out.count() and set(rows) <= set(before)
        if name != names[-1]:
            assert out.columns == COLUMNS and all(r.n_chars == len(r.text) for r in rows.values())
        if name == "quality classifier":
            model = quality_model.fit(docs)
            for i, r in before.items():
                score = model.scorer.score([quality_model.features(*quality_model.statistics(r.text.encode()))])[0]
                assert (i in rows) == (score >= quality_model.KEEP)
        elif name == "line dedup":
            expected = {i: t for i, t, _, g in boilerplate([(r.doc_id, r.text, r.source) for r in before.values()]) if t.strip(" ") or not g}
            assert {i: r.text for i, r in rows.items()} == expected
        elif name == "SimHash near-dedup":
            groups = {r.doc_id: r.component_id for r in simhash.near_groups(docs).collect()}
            assert set(rows) == {i for i in before if groups[i] == i}
        elif name == "benchmark decontamination":
            assert set(rows) == {i for i, _, hit, _ in leaks([(r.doc_id, r.text) for r in before.values()], bench) if not hit}
        else:
            pieces = sentencepiece_viterbi.load_pieces()
            assert set(rows) == set(before)
            assert all(r.round_trip and r.n_tokens == len(r.token_ids) for r in rows.values())
            for i in sorted(rows)[:40]:
                assert rows[i].token_ids == pieces.encode(before[i].text)
        docs = out
    assert 0 < docs.count() < len(bench) + 200


def test_run_is_the_stages(spark, tables):
    out = C.run(spark, tables)
    assert out.columns == ["doc_id", "token_ids", "n_tokens", "round_trip"] and out.where(~F.col("round_trip")).count() == 0


def test_nulls_and_empty_tables(spark, tables):
    schema = spark.read.parquet(f"{tables}/documents.parquet").schema
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "Some fine words in a line.", "en", None, 26), (3, "word " * 30_000, "en", "s", 150_000)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in C.STAGES:
            docs = materialize(stage(spark, docs, tables), "test-edge")
        assert docs.count() <= len(data)


def test_shared_folder(spark):
    assert shared_dir(spark) == shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


@pytest.mark.parametrize("n", [0, 50, 5000])
def test_bounded_sample(spark, n):
    rows = spark.range(n)
    found = bounded_sample(rows, n, 100, F.xxhash64("id"))
    assert found.count() == n if n <= 100 else 60 < found.count() <= 100
