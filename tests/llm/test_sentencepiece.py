import random

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from quillbit.llm import sentencepiece_viterbi as S


@pytest.fixture(scope="module")
def pieces():
    return S.load_pieces()


def varint(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


@pytest.fixture(scope="module")
def library():
    """The public library on the same pieces, told that they are a Unigram model."""
    with open(S.MODEL, "rb") as f:
        model = f.read()
    out = b""
    for number, value in S._fields(model):
        if number == 2:
            at = value.index(b"\x18\x02")  # model_type: BPE
            value = value[:at] + b"\x18\x01" + value[at + 2 :]
        out += varint(number << 3 | 2) + varint(len(value)) + value
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_agrees_with_the_library(spark, tables, pieces, library):
    words = sorted({w for r in spark.read.parquet(f"{tables}/documents.parquet").select("text").collect() for w in r.text.split()})
    found = [np.frombuffer(x, dtype="<i4").tolist() for x in pieces.encode_all([w.encode() for w in words])]
    assert len(words) > 5000
    assert found == [library.nbest_encode_as_ids(w, 2)[0] for w in words]


def brute(pieces, text):
    """Best sum of scores by trying every piece at every place."""
    data = b" " + text.replace("▁", " ").encode()
    table = {}
    for i, s in enumerate(pieces.surface):
        if i not in set(pieces.byte_ids.tolist()) and s and i > 2:
            table[s] = float(pieces.scores[i])
    best = [0.0] + [-np.inf] * len(data)
    for i in range(len(data)):
        if best[i] == -np.inf:
            continue
        step = S.char_length(data, i)
        for j in range(i + 1, min(len(data), i + pieces.longest) + 1):
            if data[i:j] in table:
                best[j] = max(best[j], best[i] + table[data[i:j]])
        if data[i : i + step] not in table:
            best[i + step] = max(best[i + step], best[i] + pieces.unknown_score)
    return best[-1]


def score(pieces, ids):
    """Sum of scores; the bytes of an unknown character are one unknown."""
    total, at, is_byte = 0.0, 0, set(pieces.byte_ids.tolist())
    while at < len(ids):
        if ids[at] in is_byte:
            first = pieces.surface[ids[at]][0]
            total += pieces.unknown_score
            at += 1 if first < 0xC0 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
        else:
            total += float(pieces.scores[ids[at]])
            at += 1
    return total


TEXTS = ["", " ", "  ", "a", "Hello  world", "日本 x 𐎀𐎁", "a\nb\n\n c", "\0\t\r", "é" * 30, "x" * 300, "the " * 50, "▁a▁", "trailing  ", "don't—stop…"]


@pytest.mark.parametrize("text", TEXTS)
def test_optimal_and_reversible(pieces, text):
    ids = pieces.encode(text)
    assert score(pieces, ids) == brute(pieces, text) if text else ids == []
    assert pieces.decode(ids) == text.replace("▁", " ")


def test_scalar_and_matrix_agree(pieces):
    r = random.Random(7)
    parts = [b" " + "".join(r.choices("abcdefgé日 .-'X𐎀", k=r.randrange(1, 15))).replace(" ", "").encode() for _ in range(500)]
    assert {p: pieces.best_path(p) for p in parts} == pieces._best_paths(parts)


def test_stray_bytes(pieces):
    for data in (b"\xff\xfe abc", b"\xe6\x97", b"a\xc3"):
        assert pieces.decode_bytes(pieces.encode_all([data])[0]) == data


def test_double_array_holds_what_it_was_given():
    r = random.Random(2)
    keys = {bytes(r.choices(range(256), k=r.randrange(1, 6))): i for i in range(3000)}
    trie = S.DoubleArray(keys)
    for key, number in keys.items():
        state = 0
        for b in key:
            to = int(trie.base[state]) + b + 1
            assert trie.check[to] == state
            state = to
        assert trie.value[state] == number


def test_tables(spark, tables, pieces):
    rows = [(i, t, 5) for i, t in enumerate([*TEXTS, None, "the " * 40_000, TEXTS[4]])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, token_ids int")
    out = S.encode_texts(docs, decoded_col="decoded")
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    for r in out.collect():
        assert (r.token_ids is None) == (r.text is None)
        if r.text is not None:
            assert r.token_ids == pieces.encode(r.text) and r.decoded == r.text.replace("▁", " ")
    back = S.decode_ids(out.select("doc_id", "token_ids"))
    assert back.join(docs.select("doc_id", F.col("text").alias("t")), "doc_id").where(~F.col("text").eqNullSafe(F.replace("t", F.lit("▁"), F.lit(" ")))).count() == 0
    assert S.summarize(docs.limit(0)).count() == 0
    assert all(r.round_trip for r in S.query(spark, tables).collect())
