import random
from collections import OrderedDict

import numpy as np
import pytest

from quillbit.config import Config
from quillbit.operators.blobs import LZMA_FROM, pack_blob, unpack_blob
from quillbit.operators.codec import MatchTable, Model, NgramTables, decode_chunks, encode_chunks
from quillbit.operators.scorer import AdaptiveUnigram, Fixed, window_probs

TEXT = b"The quick brown fox jumps over the lazy dog.\n" * 8


@pytest.mark.parametrize("flags", range(16))
def test_every_flag_combination_is_lossless(flags):
    config = Config().with_flags(flags)
    chunks = [TEXT, b"", b"x", bytes(range(256)), TEXT[:101]]
    coded = encode_chunks(chunks, config)
    assert decode_chunks([(c[0], c[2]) for c in coded], config) == chunks
    assert coded[1][0] == 0 and len(coded[1][2]) == 1


@pytest.mark.parametrize("temperature", [0.8, 0.12345, 1.5])
def test_temperature(temperature):
    config = Config(temperature=temperature)
    assert config.temperature == round(temperature * 10_000) / 10_000
    coded = encode_chunks([TEXT], config)
    assert decode_chunks([(coded[0][0], coded[0][2])], config) == [TEXT]


def test_company_does_not_change_the_bytes():
    r = random.Random(1)
    chunks = [bytes(r.choices(b"abc \n", k=r.randrange(0, 300))) for _ in range(90)]
    alone = [encode_chunks([c])[0][2] for c in chunks[:12]]
    assert [c[2] for c in encode_chunks(chunks)][:12] == alone


def test_repetition_is_learnt():
    coded = encode_chunks([TEXT * 4])[0]
    assert len(coded[2]) < len(TEXT * 4) // 8 and coded[3] > 0


def test_other_scorer():
    make = lambda: Fixed(np.arange(1, 257))
    coded = encode_chunks([TEXT], scorer=make)
    assert decode_chunks([(coded[0][0], coded[0][2])], scorer=make) == [TEXT]
    probs = window_probs(AdaptiveUnigram(), list(TEXT[:50]), 256)
    assert probs.shape == (50, 256) and np.allclose(probs.sum(1), 1)


class PlainNgrams:
    """The capped tables, written with ordered dictionaries."""

    def __init__(self, order, inner, cap):
        self.order, self.inner, self.cap = order, inner, cap
        self.of = [OrderedDict() for _ in range(order)]
        self.seen = []

    def update(self, t):
        for k in range(1, self.order + 1):
            if len(self.seen) < k:
                break
            key, table = tuple(self.seen[-k:]), self.of[k - 1]
            if key not in table:
                if len(table) >= self.cap:
                    table.popitem(last=False)
                table[key] = [OrderedDict({t: 1}), 1]
                continue
            counts = table[key][0]
            if t in counts:
                counts[t] += 1
                table[key][1] += 1
            elif len(counts) < self.inner:
                counts[t] = 1
                table[key][1] += 1
            elif min(counts.values()) == 1:
                counts.pop(next(x for x, n in counts.items() if n == 1))
                counts[t] = 1
        self.seen.append(t)


def test_ngram_caps():
    config = Config(inner_cap=3, ngram_cap=5)
    ours, plain = NgramTables(config), PlainNgrams(4, 3, 5)
    r = random.Random(5)
    for _ in range(400):
        t = r.choice([1, 1, 1, 2, 3, 4, 5, 6])
        ours.update(t)
        plain.update(t)
        for a, b in zip(ours.tables, plain.of, strict=True):
            packed = {sum(t << 8 * i for i, t in enumerate(reversed(k))): (dict(c), n) for k, (c, n) in b.items()}
            assert {k: (dict(c), n[0]) for k, (c, n) in a.items()} == packed


def test_65_continuations():
    for twice in (False, True):
        t = NgramTables(Config(ngram_order=1))
        for w in range(100, 164):
            for _ in range(2 if twice else 1):
                t.update(1)
                t.update(w)
        t.update(1)
        t.update(7)
        counts, total = t.tables[0][1]
        assert len(counts) == 64 and (7 in counts) is not twice
        assert total[0] == (128 if twice else 64)


def test_longest_match_wins():
    m = MatchTable(Config())
    for t in [9, 1, 2, 3, 4, 5, 8, 1, 2, 3, 4, 6, 9, 1, 2, 3, 4]:
        m.update(t)
    assert m.predict() == 5  # order 5 (9 1 2 3 4) before order 4 (1 2 3 4 -> 6)


def test_warmup_uses_the_first_model_only():
    model = Model(1, Config(skip=False), AdaptiveUnigram())
    for i in range(103):
        p = model.predict(1)
        assert np.isclose(p.sum(), 1)
        assert (model.parts is None) == (i < 100)
        if i <= 100:
            assert np.allclose(model.logs[0], np.log([0.85, 0.075, 0.075]))
        model.learn(np.array([65]))


@pytest.mark.parametrize("size", [0, 1, LZMA_FROM - 1, LZMA_FROM, 3 * LZMA_FROM])
def test_blobs(size):
    method, data = pack_blob(b"a" * size)
    assert unpack_blob(method, data) == b"a" * size
    assert method == ("L" if size >= LZMA_FROM else "G" if size > 1 else "R")
    noise = random.Random(2).randbytes(size)
    assert pack_blob(noise) == ("R", noise)


def test_the_scorer_is_spared_where_the_ngrams_are_sure():
    asked = []

    class Counting(AdaptiveUnigram):
        def probs(self, sequences):
            asked.append(len(sequences))
            return super().probs(sequences)

    chunks = [TEXT * 3, TEXT, b"short"]
    coded = encode_chunks(chunks, scorer=Counting)
    assert sum(asked) == sum(c[0] - c[3] for c in coded) and coded[0][3] > 0
    assert decode_chunks([(c[0], c[2]) for c in coded], scorer=Counting) == chunks


@pytest.mark.parametrize("temperature", [0.8, 1.0, 1.3])
def test_bytes_containers_are_read_by_their_headers(temperature):
    """All flags: what the header says is enough to read a container."""
    from quillbit.config import recorded
    from quillbit.operators.container import pack_bytes_container, parse_bytes_container

    for flags in range(16):
        config = Config(temperature=temperature).with_flags(flags)
        tokens, bits, stream = encode_chunks([TEXT[:150]], config)[0][:3]
        data = pack_bytes_container(config, [("T", 150), ("B", 3)], b"abc", {0: [{"tokens": tokens, "bits": bits, "stream": stream}]})
        found = parse_bytes_container(data)
        part = found["parts"][0]
        assert decode_chunks([(part["tokens"], part["stream"])], recorded(found["flags"], found["temperature"], None, Config())) == [TEXT[:150]]
        assert found["blob"] == b"abc" and found["flags"] == config.flags


def test_sums_are_the_same_in_any_order():
    """The JVM's kernel sums only the bytes that a chunk had, in its own order."""
    from quillbit.operators.codec import total_of

    r = np.random.default_rng(3)
    for most in (4, 256):
        x = r.random(256) ** 9 * most / 256
        sums = {float(total_of(x[r.permutation(256)], most)) for _ in range(50)}
        assert len(sums) == 1 and np.isclose(sums.pop(), x.sum(), rtol=1e-9)
