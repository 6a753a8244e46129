import random

import numpy as np
import pytest
import xxhash

from quillbit.llm import simhash as H
from quillbit.llm.components import components


def fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(pairs, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def near(values, radius=3):
    return [(a, b) for i, a in enumerate(values) for b in values[:i] if bin(a ^ b).count("1") <= radius]


def test_fingerprints():
    texts = [None, "", " \n", "One", "one two", "a b c", "A B C d", "é\x0bü x y", "nbsp one two", "a b c " * 2000]
    found = H.fingerprints([None if t is None else t.encode() for t in texts])
    assert found.tolist() == [fingerprint(t) for t in texts]
    assert H.fingerprints([b"a b c d e f g"], 5)[0] == fingerprint("a b c d e f g", 5)


def family(r, n, flips):
    centre = r.getrandbits(64)
    out = set()
    for _ in range(n):
        v = centre
        for _ in range(r.randrange(flips + 1)):
            v ^= 1 << r.randrange(64)
        out.add(v)
    return out


@pytest.mark.parametrize("seed", range(6))
def test_trie_join(seed):
    r = random.Random(seed)
    groups = [sorted(family(r, r.randrange(1, 120), r.randrange(1, 7)) | {r.getrandbits(64) for _ in range(40)}) for _ in range(3)]
    values = np.array([v for g in groups for v in g], dtype=np.uint64)
    number = np.array([i for i, g in enumerate(groups) for _ in g])
    first = H.trie_components(values, number)
    at = 0
    for g in groups:
        expected = roots([(g.index(a), g.index(b)) for a, b in near(g)], range(len(g)))
        assert [x - at for x in first[at : at + len(g)].tolist()] == [expected[i] for i in range(len(g))]
        at += len(g)


def test_trie_join_in_small_pieces(monkeypatch):
    monkeypatch.setattr(H, "FRONTIER", 16)
    monkeypatch.setattr(H, "LEAF_PAIRS", 2)
    test_trie_join(9)


@pytest.mark.parametrize("n", [10, 10**7, 10**10, 10**12])
def test_every_close_pair_shares_a_key(n):
    r = random.Random(n)
    masks = H.block_masks(n)
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for k in r.sample(range(64), 3):
            b ^= 1 << k
        assert any(a & m == b & m for m in masks)


def test_components(spark):
    r = random.Random(4)
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, i) for i in range(1001, 1400)]
    loose = [(r.randrange(2000, 2300), r.randrange(2000, 2300)) for _ in range(250)]
    pairs = [*chain, *star, *loose, (5, 5), (-3, 7)]
    r.shuffle(pairs)
    nodes = {x for p in pairs for x in p}
    expected = {k: v for k, v in roots(pairs, nodes).items() if k != v}
    found = {x.node: x.root for x in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert found == expected
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_query(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet").collect()
    prints = {d.doc_id: fingerprint(d.text) for d in docs}
    values = sorted(set(prints.values()))
    root = roots(near(values), values)
    least = {}
    for i, v in prints.items():
        least[root[v]] = min(i, least.get(root[v], i))
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in H.query(spark, tables).collect()}
    assert found == {i: (f"{v:016x}", least[root[v]]) for i, v in prints.items()}


def test_dedup(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(4, base), (2, base), (2, base), (9, base + " more"), (5, "other text here"), (None, base), (None, None), (7, None), (6, ""), (8, "x " * 60_000)]
    docs = spark.createDataFrame([(*x, 1, "c") for x in rows], "doc_id long, text string, fp int, component_id string")
    kept = H.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([2, 5, 6, 8, None, None], key=repr)
    assert H.near_dedup(docs.limit(0)).count() == 0
    groups = {(r.doc_id, r.component_id) for r in H.near_groups(docs.where("doc_id is null")).collect()}
    assert groups == {(None, None)}


def test_large_keys_are_divided(spark, monkeypatch):
    r = random.Random(8)
    monkeypatch.setattr(H, "TASK_ROWS", 40)
    centre = r.getrandbits(64)
    values = sorted(family(r, 500, 12) | {centre ^ (r.getrandbits(30) << 34) for _ in range(400)} | {r.getrandbits(64) for _ in range(50)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    edges = H.linked(spark.createDataFrame([(v,) for v in signed], "fp long"), len(values)).collect()
    bare = lambda v: v & (1 << 64) - 1
    assert roots([(bare(e.u), bare(e.v)) for e in edges], values) == roots(near(values), values)


def test_one_id_with_different_texts(spark):
    """Every group keeps one row, whatever ids it shares with others."""
    a, b = (" ".join(f"{x}{i}" for i in range(50)) for x in "ab")
    rows = [(1, a), (1, b), (9, b), (9, a), (1, a), (2, "c d e"), (2, None)]
    kept = H.near_dedup(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted([(1, a), (1, b), (2, "c d e"), (2, None)], key=repr)
