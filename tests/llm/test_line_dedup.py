import hashlib
import math

import pytest
from pyspark.sql import functions as F

from quillbit.llm import line_dedup as L


def brute(rows, min_sites=5, min_words=3):
    """rows: (id, text, site)."""
    sites, first = {}, {}
    for i, t, s in rows:
        for line in (t.split("\n") if t is not None else []):
            k = line.strip(" ")
            if k and k.count(" ") + 1 >= min_words:
                sites.setdefault(k, set()).update([s] if s is not None else [])
                if i is not None:
                    first[k] = min(i, first.get(k, i))
    gone = {k for k, s in sites.items() if len(s) >= min_sites}
    out = []
    for i, t, s in rows:
        if t is None:
            out.append((i, None, 0, 0))
            continue
        lines = t.split("\n")
        kept = [x for x in lines if not (x.strip(" ") in gone and first.get(x.strip(" ")) != i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=repr)


FOOT = "All rights reserved by us."
ROWS = [
    *[(i, f"own line number {i}\n {FOOT} \nshort\n\nAnother line of mine {i}", f"s{i % 7}") for i in range(3, 40)],
    (50, FOOT + "\n" + FOOT, "s1"),
    (50, FOOT + "\n" + FOOT, "s1"),
    (60, None, "s1"),
    (61, "", "s2"),
    (62, FOOT, None),
    (None, FOOT + "\nno id here at all", "s3"),
    *[(70 + i, "four sites have this line", f"s{i % 4}") for i in range(30)],
    *[(200 + i, "one hot site repeats this", "hot") for i in range(60)],
    *[(300 + i, "five sites and one of them hot", f"s{min(i, 4)}") for i in range(50)],
    *[(400 + i, "null sites do not count here", f"s{i % 4}" if i % 2 else None) for i in range(30)],
    (900, "\n".join(["unique line of words " + str(i) for i in range(20_000)] + [FOOT]), "s5"),
]


@pytest.mark.parametrize("min_sites", [1, 2, 5, 7, 14])
def test_against_brute(spark, min_sites):
    docs = spark.createDataFrame([(i, t, s, 1, 2) for i, t, s in ROWS], "doc_id long, text string, source string, pos int, lines_in int")
    found = L.dedup_lines(docs.drop("lines_in"), min_sites=min_sites, counts=True)
    got = sorted(((r.doc_id, r.text, r.lines_in if r.text is not None else 0, max(0, r.lines_removed)) for r in found.collect()), key=repr)
    assert got == brute(ROWS, min_sites)
    assert L.dedup_lines(docs, min_sites=min_sites).columns == docs.columns


def test_sketch_never_proves_too_much(spark):
    """Where the sketch decides, the exact count agrees; and its estimate is the
    rounded linear count that the decision inverts."""
    rows = spark.range(1, 60).select(F.explode(F.sequence(F.lit(1), F.col("id"))).alias("s"), F.col("id").alias("n"), F.explode(F.sequence(F.lit(1), F.lit(20))).alias("salt"))
    est = rows.groupBy("n", "salt").agg(F.approx_count_distinct(F.xxhash64("s", "salt"), L.SKETCH_ERROR).alias("e")).collect()
    possible = {round(L.REGISTERS * math.log(L.REGISTERS / (L.REGISTERS - v))) for v in range(1, 15)}
    for r in est:
        for t in range(2, L.PROVEN + 1):
            if r.e >= round(L.REGISTERS * math.log(L.REGISTERS / (L.REGISTERS - t))):
                assert r.n >= t
        if r.e <= max(possible):
            assert r.e in possible


def test_empty_and_query(spark, tables):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert L.dedup_lines(docs).count() == 0
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{tables}/documents.parquet").collect()]
    found = sorted(tuple(r) for r in L.query(spark, tables).collect())
    assert found == sorted((i, n, g, hashlib.md5(t.encode()).hexdigest()) for i, t, n, g in brute(rows))
    assert sum(r[2] for r in found) > 0
