import math
import zlib
from collections import Counter, defaultdict

import numpy as np

from quillbit.llm import backoff_lm as L

TEXTS = ["the cat sat on the mat the cat sat on the mat", "The dog sat on the log", "a cat and a dog and a cat", "the cat sat on the log", "dog cat dog cat dog cat", None, "", "  \n "] * 6 + ["unseen words here", "x " * 3000]


def tokens(t):
    return (t or "").encode().lower().split() + [L.END]


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def brute(texts):
    """The same model from its definition: plain dictionaries of contexts, and a
    recursive backoff instead of states."""
    train = [tokens(t) for i, t in texts if not held(i)]
    c = Counter(w for t in train for w in t)
    total, floor = sum(c.values()), sum(c.values()) + len(c) + 1
    uni = lambda w: (c[w] + 1) / floor
    least = L.LEAST
    use = {w for w in c if c[w] >= least}
    pair, triple = Counter(), Counter()
    for t in train:
        line = [None, *t]
        for a, b in zip(line, line[1:]):
            if (a is None or a in use) and b in use:
                pair[a, b] += 1
        for a, b, d in zip(line, line[1:], line[2:]):
            if (a is None or a in use) and b in use and d in use:
                triple[a, b, d] += 1
    pair = {k: n for k, n in pair.items() if n >= least}
    triple = {k: n for k, n in triple.items() if n >= least and k[:2] in pair and k[1:] in pair}
    seen = lambda a: len(train) if a is None else c[a]
    follow = defaultdict(dict)
    for (a, b), n in pair.items():
        e = seen(a) * uni(b)
        if n >= e + 3 * math.sqrt(e) + 1:
            follow[a,][b] = (n - L.DISCOUNT) / seen(a)

    def p(context, w):
        if not context:
            return uni(w)
        if w in follow.get(context, {}):
            return follow[context][w]
        own = follow.get(context)
        if not own:
            return p(context[1:], w)
        return (1 - sum(own.values())) / (1 - sum(p(context[1:], x) for x in own)) * p(context[1:], w)

    longer = defaultdict(dict)
    for (a, b, d), n in triple.items():
        e = pair[a, b] * p((b,), d)
        if n >= e + 3 * math.sqrt(e) + 1 and b in follow.get((a,), {}):
            longer[a, b][d] = (n - L.DISCOUNT) / pair[a, b]
    follow.update(longer)
    out = {}
    for i, t in texts:
        line = tokens(t)
        before = [None, *line]
        score = 0.0
        for k, w in enumerate(line):
            context = tuple(before[max(0, k - 1) : k + 1])
            # A context that holds a word outside the model tells nothing of what came before it.
            while context and context not in follow:
                context = context[1:]
            score += math.log10(p(context, w))
        out[i] = (held(i), len(line), sum(c[w] > 0 for w in line), total, sum(math.log10(uni(w)) for w in line), score)
    return out, follow, uni, c


def test_against_the_definition(spark):
    texts = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, 1.0) for i, t in texts], "doc_id long, text string, score double")
    found = {r.doc_id: tuple(r)[1:] for r in L.score_texts(docs).collect()}
    expected, follow, _, _ = brute(texts)
    assert follow
    for i, want in expected.items():
        assert found[i][:4] == want[:4]
        assert math.isclose(found[i][4], want[4], rel_tol=1e-9) and math.isclose(found[i][5], want[5], rel_tol=1e-9), (i, TEXTS[i], found[i], want)


def test_each_state_is_a_distribution(spark, monkeypatch):
    """Over the whole vocabulary and what is unknown, from every state of the model."""
    kept = []
    stored = L._stored
    monkeypatch.setattr(L, "discard", lambda df: None)
    monkeypatch.setattr(L, "_stored", lambda df, label: kept.append((label, stored(df, label))) or kept[-1][1])
    texts = list(enumerate(TEXTS))
    L.score_texts(spark.createDataFrame(texts, "doc_id long, text string"))
    rows = {r.k & (1 << 64) - 1: (r.p, math.nan if r.bw is None else r.bw) for r in dict(kept)["model"].collect()}
    train = [tokens(t) for i, t in texts if not held(i)]
    words = sorted({w for t in train for w in t})
    floor = sum(map(len, train)) + len(words) + 1
    ids, begins = [], []
    for t in train:
        ids += [L.BEGIN, *(L.xxhash.xxh64_intdigest(w, L.SEED) for w in t)]
        begins += [True, *[False] * len(t)]

    def look(keys):
        found = [rows.get(int(k), (math.nan, math.nan)) for k in keys]
        return np.array([x[0] for x in found], dtype=float), np.array([x[1] for x in found], dtype=float)

    unique, number = np.unique(np.array(ids, dtype=np.uint64), return_inverse=True)
    build, made = L.Automaton.build, []
    monkeypatch.setattr(L.Automaton, "build", staticmethod(lambda *x: made.append(build(*x[:-1])) or build(*x)))
    short, known = L.local_automaton(unique, number, np.array(begins), look, -math.log10(floor))
    m = made[0]
    begin, end = int(number[0]), int(np.searchsorted(unique, np.uint64(L.END_ID)))
    real = [w for w in range(len(m.root)) if w != begin]
    assert len(real) == len(words) and len(m.fail) > 10 and any(m.fail) and known[real].all()

    def chance(state, w):
        total = 0.0
        while state and w * m.states + state not in m.arcs:
            total, state = total + m.cost[state], m.fail[state]
        return total + (m.arcs[w * m.states + state][0] if state else m.root[w])

    for state in range(len(m.fail)):
        unknown, s = -math.log10(floor), state
        while s:
            unknown, s = unknown + m.cost[s], m.fail[s]
        assert math.isclose(sum(10 ** chance(state, w) for w in real) + 10**unknown, 1, rel_tol=1e-9)
    for t in train:
        line = np.array([np.searchsorted(unique, np.uint64(L.xxhash.xxh64_intdigest(w, L.SEED))) for w in t])
        assert line[-1] == end and math.isclose(m.walk(line, [0], begin)[0], short.walk(line, [0], begin)[0], rel_tol=1e-9)


def test_held_out_texts_gain(spark):
    found = L.query(spark, "/root/testdata/sf0.01").collect()
    out = [r for r in found if r.held_out]
    assert len(out) > 100 and sum(r.score for r in out) > sum(r.base_score for r in out)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert L.score_texts(docs).count() == 0
    one = next(i for i in range(100) if held(i))
    row = L.score_texts(spark.createDataFrame([(one, "a b")], "doc_id long, text string")).first()
    assert tuple(row) == (one, True, 3, 0, 0, 0.0, 0.0)
    row = L.score_texts(spark.createDataFrame([(None, "a b a")], "doc_id long, text string")).first()
    assert row.held_out is False and row.n_tokens == row.n_known == 4


def test_threshold_stays_as_the_corpus_grows(spark, monkeypatch):
    """A cap of the broadcast model must not drop n-grams: the rest comes by joins."""
    texts = list(enumerate(TEXTS + ["rare pair here", "a rare pair there"] * 6))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    expected, follow, _, _ = brute(texts)
    monkeypatch.setattr(L, "WORDS", 4)
    monkeypatch.setattr(L, "BLOCK_TOKENS", 30)
    found = {r.doc_id: tuple(r)[1:] for r in L.score_texts(docs, ngrams=3).collect()}
    assert sum(map(len, follow.values())) > 20
    for i, want in expected.items():
        assert found[i][:4] == want[:4]
        assert math.isclose(found[i][4], want[4], rel_tol=1e-9) and math.isclose(found[i][5], want[5], rel_tol=1e-9), (i, found[i], want)


def test_answers_are_packed_by_block(spark):
    """What a block asked for is shuffled in a few rows, and none is lost or changed."""
    import pyarrow as pa

    rows = [(i % 7 - 3, i * 2654435761 - (1 << 62), -i / 7, None if i % 3 else -i / 3) for i in range(5000)]
    table = spark.createDataFrame(rows, "block long, k long, p double, bw double").coalesce(1)
    found = L.packed(table).toArrow()
    assert found.num_rows == 7
    got = []
    for i in range(found.num_rows):
        k, p, bw = L._unpacked(found.slice(i, 1))
        got += zip([found.column("block")[i].as_py()] * len(k), k.view("i8").tolist(), p.tolist(), [None if np.isnan(x) else x for x in bw.tolist()], strict=True)
    assert sorted(got, key=lambda r: r[1]) == sorted(rows, key=lambda r: r[1])
    empty = pa.table({c: pa.array([], pa.binary()) for c in ("k", "p", "bw")})
    assert [len(x) for x in L._unpacked(empty)] == [0, 0, 0]


def test_counts_go_by_shares(spark, monkeypatch):
    """N-grams of numbered and of joined words, over several tasks, rounds of a task
    and shares, are counted as in one; no row for each n-gram is shuffled."""
    texts = list(enumerate(TEXTS + ["rare pair here", "a rare pair there"] * 6))
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    expected = brute(texts)[0]
    for name, value in (("WORDS", 4), ("BLOCK_TOKENS", 30), ("TASK_GRAMS", 40), ("SHARE_GRAMS", 400)):
        monkeypatch.setattr(L, name, value)
    found = {r.doc_id: tuple(r)[1:] for r in L.score_texts(docs, ngrams=3).collect()}
    for i, want in expected.items():
        assert found[i][:4] == want[:4] and math.isclose(found[i][5], want[5], rel_tol=1e-9), (i, found[i], want)


def test_texts_are_cut_together():
    """Words of a slice's texts in arrays, and blocks of any of its texts."""
    from quillbit.llm.common import space_words

    texts = [None, b"", b" ", b"A b\x0bB\x0c\r\n b", "\u00c9t\u00e9 \u4e2d A\u00a0x".encode(), b"  x", b"x ", None, b"\x1cq\x85", b"end", b""]
    cut = L._Cut(texts)
    assert cut.sizes.tolist() == [len(space_words(t)) for t in texts]
    block = L._Block()
    import pyarrow as pa

    for chosen in ([0, 1, 3], [9], [4, 5, 6, 7, 8, 10], [2]):
        block.add(cut, np.array(chosen), pa.array(range(len(texts))))
    names = {n: w for w, n in block.words.items()}
    order = [0, 1, 3, 9, 4, 5, 6, 7, 8, 10, 2]
    assert [names[n] for n in np.concatenate(block.codes).tolist()] == [w for i in order for w in [None, *space_words(texts[i]), L.END]]
    assert pa.concat_arrays(block.ids).to_pylist() == order and block.tokens == sum(map(len, block.codes))
    assert L._Cut([None, b""]).sizes.tolist() == [0, 0]


def test_walks_take_all_words_at_a_time(monkeypatch):
    """Located and sought arcs give what one state after the other gives, and no arc is
    a Python object."""
    r = np.random.default_rng(5)
    vocabulary = np.unique(np.array([L.BEGIN, L.END_ID, *range(1000, 1020)], dtype=np.uint64))
    begin, end = (int(np.searchsorted(vocabulary, np.uint64(x))) for x in (L.BEGIN, L.END_ID))
    others = [i for i in range(len(vocabulary)) if i not in (begin, end)]
    texts = [[begin, *r.choice(others, n).tolist(), end] for n in (0, 1, 2, 300, 0, 500, 40)]
    number = np.concatenate(texts)
    ids = vocabulary[number]
    pair = {int(k) for k in L._mix(ids[:-1], ids[1:])[r.random(len(ids) - 1) < 0.6]}
    triple = {int(k) for k in L._mix(L._mix(ids[:-2], ids[1:-1]), ids[2:])[r.random(len(ids) - 2) < 0.5]}
    model = {k: (-float(r.random()), -float(r.random())) for k in [*map(int, vocabulary), *pair, *triple]}

    def look(keys):
        found = [model.get(int(k), (np.nan, np.nan)) for k in keys]
        return np.array([x[0] for x in found], dtype=float), np.array([x[1] for x in found], dtype=float)

    m, _ = L.local_automaton(vocabulary, number, number == begin, look, -9.0)
    line = number[number != begin]
    starts = np.cumsum([0, *(len(t) - 1 for t in texts)])[:-1].tolist()
    expected = []
    for t in texts:
        total, state = float(m.root[begin] - m.base[begin]), int(m.first[begin])
        for w in t[1:]:
            while state and int(w) * m.states + state not in m.arcs:
                total, state = total + m.cost[state], int(m.fail[state])
            p, state = m.arcs[int(w) * m.states + state] if state else (m.root[w], int(m.first[w]))
            total += p
        expected.append(total)
    assert len(m.arcs.keys) > 100 and m.states > m.single + 1
    assert isinstance(m.arcs.keys, np.ndarray)
    assert np.allclose(m.walk(line, starts, begin), expected, rtol=1e-12)
    assert np.allclose(m.walk(line, starts, begin, m.found), expected, rtol=1e-12)
