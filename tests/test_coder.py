"""The coder as properties over generated symbols and tables; and quantisation."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quillbit.operators.coder import Decoder, decode_symbols, encode_symbols, quantize


def table(widths):
    return np.concatenate(([0], np.cumsum(widths)))


widths = st.lists(st.integers(1, 1 << 12), min_size=2, max_size=300)


@st.composite
def messages(draw):
    """Symbols with one table, or with a table for each of them."""
    n = draw(st.integers(0, 60))
    own = draw(st.lists(widths, min_size=1, max_size=1) if draw(st.booleans()) else st.lists(widths, min_size=max(n, 2), max_size=max(n, 2)))
    tables = [table(w) for w in own]
    return [draw(st.integers(0, len(tables[i if len(tables) > 1 else 0]) - 2)) for i in range(n)], tables


@settings(max_examples=150, deadline=None)
@given(messages())
def test_decoding_inverts_encoding(message):
    symbols, tables = message
    data, bits = encode_symbols(symbols, tables)
    assert decode_symbols(data, len(symbols), tables) == symbols
    assert encode_symbols(symbols, tables) == (data, bits) and bits <= 8 * len(data) <= bits + 16


@settings(max_examples=60, deadline=None)
@given(widths, st.integers(0, 10**6))
def test_length_is_near_the_information(w, seed):
    symbols = np.random.default_rng(seed).choice(len(w), 400, p=np.array(w) / sum(w)).tolist()
    ideal = sum(np.log2(sum(w) / w[s]) for s in symbols)
    assert abs(encode_symbols(symbols, [table(w)])[1] - ideal) < 3 + 0.001 * ideal


def test_reading_past_the_end_gives_zeros():
    assert Decoder(b"").decode(table([16, 16, 16, 16])) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.floats(0, 1), min_size=2, max_size=200), st.integers(0, 16))
def test_quantized_tables_are_whole(weights, extra):
    total = (1 << 12) + extra
    p = np.array(weights) + 1e-12
    cdf = quantize((p / p.sum())[None], total)[0]
    assert cdf[0] == 0 and cdf[-1] == total and (np.diff(cdf) >= 1).all()


def test_the_rest_goes_to_the_first_of_the_largest():
    counts = np.diff(quantize(np.array([[0.1, 0.45, 0.45]]), 101)[0])
    assert counts.sum() == 101 and counts[1] > counts[2]
    hot = np.zeros((1, 256))
    hot[0, 7] = 1
    counts = np.diff(quantize(hot, 1 << 16)[0])
    assert counts[7] == (1 << 16) - 255 and (np.delete(counts, 7) == 1).all()
