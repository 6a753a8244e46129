"""The lossless codec: predictors, mixing and coding over many chunks in step.

Chunks are sorted by length and advance together, one token each, so every
vector step runs on a matrix of (active chunks, vocabulary). Rows never interact:
a chunk's bytes are the same in whatever company it is coded, and decoding repeats
the very same arithmetic. Logarithms and exponentials are made of single operations in a
fixed order and sums are exact, so that they are the same on every machine and in the
JVM (``codec_jvm``), which codes rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

from quillbit.config import SKIP_LZP, SKIP_NGRAM, Config
from quillbit.operators.coder import Decoder, Encoder, quantize
from quillbit.operators.scorer import AdaptiveUnigram, Scorer

#: Steps of the adaptive bias up to this size multiply its odds one by one; odds are
#: divided by their largest after so many steps.
SMALL, EVERY = 1 / 64, 64
#: Chunks that advance together; a bound of memory, without effect on the bytes.
TOGETHER = 64


class History:
    """The last tokens of a sequence as one number, newest in the lowest bits; the
    number under a mask is the context of an order."""

    __slots__ = ("masks", "seen", "shift", "value")

    def __init__(self, config: Config, most: int):
        self.shift = max(1, (config.vocabulary - 1).bit_length())
        self.masks = [(1 << self.shift * k) - 1 for k in range(most + 1)]
        self.value = self.seen = 0

    def add(self, token: int) -> None:
        self.value = (self.value << self.shift | token) & self.masks[-1]
        self.seen += 1


class NgramTables:
    """Contexts of each order with the tokens that followed them, for a sequence.
    Both levels are bounded: a full context replaces its oldest single count, or
    takes no more tokens; a full order forgets the context it met first."""

    __slots__ = ("cap", "history", "inner", "orders", "tables")

    def __init__(self, config: Config):
        self.tables: list[dict[int, tuple[dict[int, int], list[int]]]] = [{} for _ in range(config.ngram_order)]
        self.history = History(config, config.ngram_order)
        self.orders = list(zip(self.tables, self.history.masks[1:], strict=True))
        self.inner, self.cap = config.inner_cap, config.ngram_cap

    def _known(self) -> list:
        return self.orders if self.history.seen >= len(self.orders) else self.orders[: self.history.seen]

    def found(self) -> list[tuple[dict[int, int], list[int]]]:
        """(counts, [total]) for each order whose context is known, shortest first."""
        value = self.history.value
        return [slot for table, mask in self._known() if (slot := table.get(value & mask)) is not None]

    def update(self, token: int) -> None:
        value = self.history.value
        for table, mask in self._known():
            key = value & mask
            slot = table.get(key)
            if slot is None:
                if len(table) >= self.cap:
                    del table[next(iter(table))]
                table[key] = ({token: 1}, [1])
                continue
            counts, total = slot
            if token in counts:
                counts[token] += 1
                total[0] += 1
            elif len(counts) < self.inner:
                counts[token] = 1
                total[0] += 1
            else:
                oldest = next((t for t, n in counts.items() if n == 1), None)
                if oldest is not None:
                    del counts[oldest]
                    counts[token] = 1
        self.history.add(token)


class MatchTable:
    """The last token that followed each context of the match orders, in one table:
    a key is the context above the order."""

    __slots__ = ("cap", "history", "orders", "table")

    def __init__(self, config: Config):
        self.table: dict[int, int] = {}
        self.history = History(config, config.lzp_order)
        self.orders = [(k, self.history.masks[k]) for k in range(config.lzp_least, config.lzp_order + 1)]
        self.cap = config.lzp_cap

    def _keys(self) -> list[int]:
        value, seen = self.history.value, self.history.seen
        return [(value & mask) << 8 | k for k, mask in self.orders if k <= seen]

    def predict(self) -> int:
        table = self.table
        for key in reversed(self._keys()):
            found = table.get(key)
            if found is not None:
                return found
        return -1

    def update(self, token: int) -> None:
        table = self.table
        for key in self._keys():
            if len(table) >= self.cap and key not in table:
                del table[next(iter(table))]
            table[key] = token
        self.history.add(token)


_LN2 = (6.93147180369123816490e-01, 1.90821492927058770002e-10)
_LOG = (1.479819860511658591e-01, 1.531383769920937332e-01, 1.818357216161805012e-01, 2.222219843214978396e-01, 2.857142874366239149e-01, 3.999999999940941908e-01, 6.666666666666735130e-01)
_EXP = [1.0 / math.factorial(k) for k in range(13, -1, -1)]
_LOG2E = 1.4426950408889634


def log(x: np.ndarray) -> np.ndarray:
    """Natural logarithms of positive numbers."""
    m, e = np.frexp(x)
    low = m < 0.70710678118654752
    f = np.where(low, m + m, m) - 1.0
    e = np.where(low, e - 1.0, e)
    s = f / (f + 2.0)
    z = s * s
    r = np.full_like(z, _LOG[0])
    for k in _LOG[1:]:
        r = r * z + k
    r *= z
    h = f * 0.5 * f
    return e * _LN2[0] - ((h - (s * (h + r) + e * _LN2[1])) - f)


def exp(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, -700.0)
    k = np.rint(x * _LOG2E)
    r = (x - k * _LN2[0]) - k * _LN2[1]
    p = np.full_like(r, _EXP[0])
    for c in _EXP[1:]:
        p = p * r + c
    return np.ldexp(p, k.astype(np.int64))


def total_of(x: np.ndarray, most: int = 256) -> np.ndarray:
    """Sums of the last axis. Each number is rounded to a step that depends only on
    ``most``, which bounds the sum, so sums are exact and the same in any order."""
    shift = 1.5 * most
    return ((x + shift) - shift).sum(-1)


def entropy_bits(p: np.ndarray) -> np.ndarray:
    return -total_of(p * (log(p + 1e-10) * _LOG2E))


def softmax(logits: np.ndarray) -> np.ndarray:
    e = exp(logits - logits.max(-1, keepdims=True))
    return e / total_of(e, max(256, 1 << (e.shape[-1] - 1).bit_length()))[..., None]


def grown(x: np.ndarray) -> np.ndarray:
    """exp(x) for numbers that are at most ``SMALL``."""
    p = x * _EXP[7] + _EXP[8]
    for c in _EXP[9:]:
        p = p * x + c
    return p


class Model:
    """The state of a group of sequences that advance in step."""

    def __init__(self, sequences: int, config: Config, scorer: Scorer):
        self.config, self.scorer, self.step = config, scorer, 0
        v = config.vocabulary
        scorer.start(sequences, v)
        self.unigram = np.ones((sequences, v))
        self.ngrams = [NgramTables(config) for _ in range(sequences)]
        self.matches = [MatchTable(config) for _ in range(sequences)]
        self.bias = np.zeros((sequences, v))
        # exp(bias), but for a factor of each row, kept where the steps are small.
        self.odds = np.ones((sequences, v)) if abs(config.adaptive_rate) <= SMALL else None
        first = [0.85] + [0.15 / (config.models - 1)] * (config.models - 1) if config.models > 1 else [1.0]
        self.logs = np.repeat(log(np.array(first))[None], sequences, axis=0)
        self.skips = np.zeros(sequences, dtype=np.int64)

    def _ngram(self, active: int) -> np.ndarray:
        keep, extra = np.ones(active), np.zeros((active, self.config.vocabulary))
        found = [self.ngrams[i].found() for i in range(active)]
        for level in range(self.config.ngram_order):
            rows = [i for i in range(active) if len(found[i]) > level]
            if not rows:
                break
            slots = [found[i][-1 - level] for i in rows]  # longest first
            totals = np.array([s[1][0] for s in slots], dtype=float)
            trust = totals / (totals + 5)
            sizes = [len(s[0]) for s in slots]
            ids = np.fromiter(chain.from_iterable(s[0] for s in slots), dtype=np.int64, count=sum(sizes))
            counts = np.fromiter(chain.from_iterable(s[0].values() for s in slots), dtype=float, count=sum(sizes))
            extra[np.repeat(rows, sizes), ids] += np.repeat(trust / totals * keep[rows], sizes) * counts
            keep[rows] *= 1 - trust
        return self.unigram[:active] * (keep / (self.step + self.config.vocabulary))[:, None] + extra

    def _match(self, active: int) -> np.ndarray:
        v = self.config.vocabulary
        p = np.full((active, v), 1 / v)
        guess = np.array([self.matches[i].predict() for i in range(active)])
        rows = np.flatnonzero(guess >= 0)
        p[rows] = 0.15 / (v - 1)
        p[rows, guess[rows]] = 0.85
        return p

    def predict(self, active: int) -> np.ndarray:
        """One distribution for each active sequence; keeps what ``learn`` needs. The
        scorer is asked only for sequences of which the n-grams aren't sure."""
        c = self.config
        warm = self.step < c.warmup
        if self.odds is not None and self.step % EVERY == 0:
            self.odds /= self.odds.max(-1, keepdims=True)
        self.used, self.parts = np.arange(active), None
        ngram = self._ngram(active) if c.ngram and not warm else None
        match = self._match(active) if c.lzp and not warm else None
        if c.skip and ngram is not None:
            sure = entropy_bits(ngram) < c.skip_bits
            self.used = np.flatnonzero(~sure)
            self.skips[:active] += sure
        if len(self.used):
            self.raw = self.scorer.probs(self.used)
            if c.temperature != 1.0:
                self.raw = softmax(log(self.raw + 1e-10) / c.temperature)
        if warm:
            return self.raw
        p = np.empty((active, c.vocabulary))
        if len(self.used) < active:
            fast = SKIP_NGRAM * ngram[sure] + SKIP_LZP * match[sure] if match is not None else ngram[sure]
            p[sure] = fast
        if len(self.used):
            if c.adaptive:
                if self.odds is None:
                    bias = self.bias[self.used]
                    odds = exp(bias - bias.max(-1, keepdims=True))
                else:
                    odds = self.odds[self.used]
                raw = (self.raw + 1e-10) * odds
                self.raw = raw * (1.0 / total_of(raw, 4))[:, None]
            self.parts = np.stack([self.raw, *(x[self.used] for x in (ngram, match) if x is not None)])
            p[self.used] = (softmax(self.logs[self.used]).T[:, :, None] * self.parts).sum(0)
        return p

    def learn(self, tokens: np.ndarray) -> None:
        c, use = self.config, self.used
        if len(use):
            rows = np.arange(len(use))
            if self.parts is not None:
                self.logs[use] += c.mixer_rate * log(np.maximum(self.parts[:, rows, tokens[use]].T, 1e-8))
                self.logs[use] -= self.logs[use].max(1, keepdims=True)
            if c.adaptive:
                step = -c.adaptive_rate * self.raw
                step[rows, tokens[use]] += c.adaptive_rate
                self.bias[use] += step
                if self.odds is not None:
                    self.odds[use] *= grown(step)
        self.unigram[np.arange(len(tokens)), tokens] += 1
        for i, t in enumerate(tokens.tolist()):
            if c.ngram:
                self.ngrams[i].update(t)
            if c.lzp:
                self.matches[i].update(t)
        self.scorer.update(tokens)
        self.step += 1


def _groups(lengths: list[int]) -> Iterator[list[int]]:
    order = sorted(range(len(lengths)), key=lambda i: -lengths[i])
    for i in range(0, len(order), TOGETHER):
        yield order[i : i + TOGETHER]


def encode_chunks(chunks: list[bytes], config: Config = Config(), scorer: Callable[[], Scorer] = AdaptiveUnigram) -> list[tuple[int, int, bytes, int, np.ndarray]]:
    """(tokens, bits, stream, skipped steps, final bias) of each chunk's bytes."""
    out: list = [None] * len(chunks)
    for group in _groups([len(c) for c in chunks]):
        model = Model(len(group), config, scorer())
        coders = [Encoder() for _ in group]
        tokens = [np.frombuffer(chunks[i], dtype=np.uint8).astype(np.int64) for i in group]
        lengths = np.array([len(t) for t in tokens])
        for step in range(lengths[0] if len(lengths) else 0):
            active = int((lengths > step).sum())
            cdf = quantize(model.predict(active), config.total)
            now = np.array([tokens[i][step] for i in range(active)])
            rows = np.arange(active)
            for coder, a, b in zip(coders, cdf[rows, now].tolist(), cdf[rows, now + 1].tolist(), strict=False):
                coder.encode(a, b, config.total)
            model.learn(now)
        for k, i in enumerate(group):
            bits = coders[k].bit_count
            out[i] = (len(tokens[k]), bits, coders[k].finish(), int(model.skips[k]), model.bias[k])
    return out


def decode_chunks(streams: list[tuple[int, bytes]], config: Config = Config(), scorer: Callable[[], Scorer] = AdaptiveUnigram) -> list[bytes]:
    """The chunks of (tokens, stream) pairs."""
    out: list[bytes] = [b""] * len(streams)
    for group in _groups([n for n, _ in streams]):
        model = Model(len(group), config, scorer())
        coders = [Decoder(streams[i][1]) for i in group]
        lengths = np.array([streams[i][0] for i in group])
        found: list[bytearray] = [bytearray() for _ in group]
        for step in range(lengths[0] if len(lengths) else 0):
            active = int((lengths > step).sum())
            cdf = quantize(model.predict(active), config.total)
            now = np.array([coders[i].decode(cdf[i]) for i in range(active)])
            for i, t in enumerate(now.tolist()):
                found[i].append(t)
            model.learn(now)
        for k, i in enumerate(group):
            out[i] = bytes(found[k])
    return out
