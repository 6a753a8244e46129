import random

import corpus_pipeline as C
import pytest

from quillbit.llm import minhash, simhash
from tests.llm.test_simhash import fingerprint, near, roots


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected_kept(rows):
    """One document of each group of near fingerprints or near shingle sets."""
    texts = {i: t for i, t in rows if i is not None}
    prints = {i: fingerprint(t) for i, t in texts.items()}
    sets = {i: shingles(t) for i, t in texts.items()}
    links = [(a, b) for a in texts for b in texts if b < a and (bin(prints[a] ^ prints[b]).count("1") <= 3 or sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    root = roots(links, texts)
    return {i for i in texts if root[i] == i}


def edited(r, words, n):
    own = list(words)
    for k in r.sample(range(len(own)), n):
        own[k] = f"new{r.randrange(5000)}"
    return " ".join(own)


def test_stage_reaches_jaccard(spark, tables):
    """What the stage keeps, against all pairs of similarity 0.8 or more."""
    r = random.Random(5)
    rows = []
    for _ in range(30):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randrange(60, 200))]
        rows += [(len(rows) + k, edited(r, words, r.randrange(0, 3))) for k in range(4)]
    rows += [(900, ""), (901, "one two"), (902, None), (None, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id for x in C.near_copies(spark, docs, tables).collect()}
    assert kept == expected_kept(rows) | {None}


@pytest.mark.parametrize("held", [3, 64])
def test_large_mixed_buckets(spark, tables, monkeypatch, held):
    """Buckets with more outsiders than NEAR get prefixes, and nothing is left out."""
    r = random.Random(6)
    monkeypatch.setattr(minhash, "NEAR", 2)
    monkeypatch.setattr(minhash, "HELD", held)
    monkeypatch.setattr(minhash, "PASSING", 2 * held)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for _ in range(25):  # families that share a passage of more than half of their words
        own = [f"w{r.randrange(9000)}" for _ in range(30)]
        rows += [(len(rows) + k, edited(r, [*passage, *own], k % 2)) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x.doc_id for x in C.near_copies(spark, docs, tables).collect()} == expected_kept(rows)
