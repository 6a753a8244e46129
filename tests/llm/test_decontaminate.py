import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quillbit.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, bench, n=10):
    out = []
    for i, text in docs:
        w, hit, items = words(text), set(), set()
        for item, other in bench:
            b = words(other)
            if not b:
                continue
            m = min(n, len(b))
            grams = {tuple(b[k : k + m]) for k in range(len(b) - m + 1)}
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in grams:
                    hit.update(range(k, k + m))
                    items.add("null" if item is None else str(item))
        out.append((i, len(w), len(hit), tuple(sorted(items))))
    return sorted(out, key=repr)


ITEM = "one two three four five six seven eight nine ten eleven twelve"
BENCH = [(3, ITEM), (12, "Alpha beta, GAMMA"), (7, None), (8, ""), (9, "é ü"), (3, ITEM), (None, "zig zag zog"), (20, "ten ten ten ten ten ten ten ten ten ten ten")]
DOCS = [
    (0, "x " + ITEM.upper().replace(" ", ", ") + " y"),
    (1, "one two three four five six seven eight nine"),
    (2, "alpha-beta gamma alpha beta"),
    (3, None),
    (4, ""),
    (5, "É ü é ü"),
    (6, "ten " * 30),
    (7, "zig zag zog " * 3 + ITEM + " " + ITEM),
    (7, "zig zag zog " * 3 + ITEM + " " + ITEM),
    (None, "alpha beta gamma"),
    (8, "clean words only " * 5000 + ITEM),
    (9, "...!!!"),
]


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 60])
def test_matches(spark, block_bytes):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = D.match_windows(docs, bench, block_bytes=block_bytes).collect()
    own = sorted([(r.doc_id, r.n_words, sum(s["last"] - s["first"] + 1 for s in r.spans), tuple(r["items"])) for r in found], key=repr)
    assert own == brute(DOCS, BENCH)


def test_removal_and_extra_columns(spark):
    rows = [(*d, 1, [1, 2]) for d in DOCS]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans int, items array<int>")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    left = D.decontaminate(docs, bench)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == [1, 3, 4, 9]
    cut = D.decontaminate(docs, bench, remove="span")
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert cut.columns == docs.columns and texts[0] == "x  y" and texts[3] is None and texts[1] == DOCS[1][1]
    assert texts[8] == "clean words only " * 5000
    assert all(r.n_hit == 0 for r in D.match_windows(cut, bench).select(F.size("spans").alias("n_hit")).collect())


def test_empty_tables(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    assert D.decontaminate(docs, bench.limit(0)).count() == len(DOCS)
    assert D.decontaminate(docs.limit(0), bench).count() == 0


def test_digest(spark, tables):
    bench = {r.item_id: r.text for r in spark.read.parquet(f"{tables}/benchmark.parquet").collect()}
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    found = sorted((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in D.query(spark, tables).collect())
    expected = sorted((i, n, h, len(k), hashlib.sha256(",".join(k).encode()).hexdigest(), h > 0) for i, n, h, k in brute(docs, list(bench.items())))
    assert found == expected
