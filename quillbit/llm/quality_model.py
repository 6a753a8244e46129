"""Weak-label quality classifier (operator 4).

Overlapping heuristic labellers each vote good, bad or nothing on a text. How
often each pattern of votes occurs is counted over all documents (at most 3^8
patterns), and expectation-maximisation on these counts estimates every
labeller's accuracy and the share of good texts. The posterior of a text's
pattern is its label. A hashed linear scorer learns these labels from a bounded
sample of at most ``sample`` rows, chosen by the hash of their texts, and then scores every text by
itself, with no join: its features are hashed word shapes and binned shape
statistics. No true label is used anywhere.

Cases: null counts as an empty text; a text without words casts no vote and has
the feature ``empty`` only; it gets the score that this feature earns, and
0.5 or more is kept. Words of any length and very long texts are looked at whole.
Repeated rows get the same score; an empty table fits a model without weights. Extra columns pass through; verdict columns of the same
name are replaced.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbit.llm.common import bounded_sample, broadcast_value, space_words, text_slices
from quillbit.session import ensure_importable, load

#: Rows that the scorer learns from, and buckets of its features.
SAMPLE = 20_000
BUCKETS = 1 << 20
KEEP = 0.5

GOOD, BAD, NONE = 1, 0, 2
LABELLERS = ("symbols", "capitals", "exclamations", "stutter", "variety", "lines", "plain_words", "bare_marks")

_SYMBOLS = b"#*$%&|<>{}[]~^\\=+@_"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_SHAPE = bytes(97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else b for b in range(256))
_MARKS = bytes(b for b in range(128) if not chr(b).isalnum())
_PLAIN = {b"a", b"Aa", b"A", b"a,", b"a.", b"Aa,", b"Aa.", b"A.", b"a?", b"a!", b"a;", b"a:", b"0", b"a'a", b"a-a"}

_RUN = re.compile(rb"([aA0])\1+")

_collapsed: dict[bytes, bytes] = {}


def _collapse(shape: bytes) -> bytes:
    out = _collapsed.get(shape)
    if out is None:
        out = _RUN.sub(rb"\1", shape)
        if len(_collapsed) < 200_000 and len(shape) <= 64:
            _collapsed[shape] = out
    return out


def statistics(text: bytes | None) -> tuple[dict[str, float], Counter]:
    """What the labellers and the features look at, and the counts of collapsed
    word shapes (letters a and A, digits 0, a run of one kind as one)."""
    words = space_words(text, lower=False)
    n = len(words)
    if not n:
        return {"n": 0}, Counter()
    assert text is not None
    size = len(text)
    upper, lower = size - len(text.translate(None, _UPPER)), size - len(text.translate(None, _LOWER))
    shapes: Counter = Counter()
    for shape, count in Counter(text.translate(_SHAPE).split()).items():
        shapes[_collapse(shape)] += count
    lines = [x for x in text.split(b"\n") if x.strip()]
    return {
        "n": n,
        "symbols": (size - len(text.translate(None, _SYMBOLS))) / n,
        "capitals": upper / max(1, upper + lower),
        "exclamations": text.count(b"!!") / n,
        "stutter": sum(map(eq, words, words[1:])) / n,
        "variety": len(set(words)) / n,
        "lines": 1 - len(set(lines)) / len(lines),
        "n_lines": len(lines),
        "bare_marks": sum(c for s, c in shapes.items() if not s.strip(_MARKS)) / n,
        "plain_words": sum(c for s, c in shapes.items() if s in _PLAIN) / n,
    }, shapes


#: (bad from, good to) for shares where more is worse, (bad to, good from) where
#: less is; between the two a labeller abstains.
MORE_IS_WORSE = {"symbols": (0.3, 0.05), "capitals": (0.4, 0.15), "exclamations": (0.2, 0.01), "stutter": (0.2, 0.03), "lines": (0.5, 0.2), "bare_marks": (0.2, 0.05)}
LESS_IS_WORSE = {"variety": (0.2, 0.45), "plain_words": (0.65, 0.85)}
#: Words or lines below which a labeller abstains.
AT_LEAST = {"plain_words": ("n", 15), "capitals": ("n", 3), "stutter": ("n", 10), "variety": ("n", 20), "lines": ("n_lines", 5)}


def votes(stats: dict[str, float]) -> tuple[int, ...]:
    out = []
    for name in LABELLERS:
        of, least = AT_LEAST.get(name, ("n", 1))
        if stats.get(of, 0) < least:
            out.append(NONE)
        elif name in MORE_IS_WORSE:
            bad, good = MORE_IS_WORSE[name]
            out.append(BAD if stats[name] >= bad else GOOD if stats[name] <= good else NONE)
        else:
            bad, good = LESS_IS_WORSE[name]
            out.append(BAD if stats[name] <= bad else GOOD if stats[name] >= good else NONE)
    return tuple(out)


def pattern(vote: tuple[int, ...]) -> int:
    return sum(v * 3**i for i, v in enumerate(vote))


def unpattern(number: int) -> list[int]:
    return [number // 3**i % 3 for i in range(len(LABELLERS))]


def features(stats: dict[str, float], shapes: Counter) -> dict[int, float]:
    """Bucket to value: shares of word shapes, and one bin of each statistic."""
    if not stats["n"]:
        return {_bucket(b"empty"): 1.0}
    out: dict[int, float] = {_bucket(b"bias"): 1.0}
    for shape, count in shapes.items():
        b = _bucket(b"shape:" + shape)
        out[b] = out.get(b, 0.0) + count / stats["n"]
    for name in LABELLERS:
        of, least = AT_LEAST.get(name, ("n", 1))
        level = min(10, int(10 * stats[name])) if stats[of] >= least else -1
        out[_bucket(f"{name}:{level}".encode())] = 1.0
    return out


def _bucket(term: bytes) -> int:
    return zlib.crc32(term) % BUCKETS


# Label model


@dataclass
class LabelModel:
    """Accuracies by expectation-maximisation: of the texts of class c on which
    labeller l votes, ``table[c, l, v]`` get vote v. That it abstains says nothing
    (short texts often give too little to go by), so its entry is 1."""

    prior: float = 0.5
    table: np.ndarray = field(default_factory=lambda: np.full((2, len(LABELLERS), 3), (0.5, 0.5, 1.0)))

    @staticmethod
    def fit(counts: dict[int, int], rounds: int = 200, smoothing: float = 1.0) -> LabelModel:
        if not counts:
            return LabelModel()
        keys = sorted(counts)
        vote = np.array([unpattern(k) for k in keys])
        weight = np.array([counts[k] for k in keys], dtype=float)
        good, bad = (vote == GOOD).sum(1), (vote == BAD).sum(1)
        # A start near the majority; bad votes weigh more, as faults are rare and specific.
        post = np.clip((good + 1) / (good + 3 * bad + 2), 0.02, 0.98)
        model = LabelModel()
        for _ in range(rounds):
            table = np.full((2, len(LABELLERS), 2), smoothing)
            for c, share in ((0, 1 - post), (1, post)):
                for v in (BAD, GOOD):
                    table[c, :, v] += (weight * share) @ (vote == v)
            table = np.concatenate([table / table.sum(2, keepdims=True), np.ones((2, len(LABELLERS), 1))], axis=2)
            model = LabelModel(float((weight @ post + smoothing) / (weight.sum() + 2 * smoothing)), table)
            new = model.posterior(vote)
            if np.abs(new - post).max() < 1e-9:
                break
            post = new
        return model

    def posterior(self, vote: np.ndarray) -> np.ndarray:
        at = np.arange(len(LABELLERS))
        logs = np.stack([np.log(self.table[c, at, vote]).sum(1) for c in (0, 1)])
        odds = np.log(self.prior) - np.log1p(-self.prior) + logs[1] - logs[0]
        return 1 / (1 + np.exp(-np.clip(odds, -40, 40)))


@dataclass
class Scorer:
    buckets: np.ndarray
    weights: np.ndarray

    @staticmethod
    def fit(rows: list[dict[int, float]], labels: np.ndarray, rounds: int = 300, rate: float = 0.1, decay: float = 1e-4) -> Scorer:
        """Logistic regression on soft labels by Adam over the whole sample."""
        buckets = np.array(sorted({b for r in rows for b in r}), dtype=np.int64)
        if not len(buckets):
            return Scorer(buckets, np.zeros(0))
        sizes = np.array([len(r) for r in rows])
        column = np.searchsorted(buckets, np.fromiter((b for r in rows for b in r), dtype=np.int64, count=sizes.sum()))
        value = np.fromiter((v for r in rows for v in r.values()), dtype=float, count=sizes.sum())
        row = np.repeat(np.arange(len(rows)), sizes)
        w, m, v = np.zeros(len(buckets)), np.zeros(len(buckets)), np.zeros(len(buckets))
        for t in range(1, rounds + 1):
            p = 1 / (1 + np.exp(-np.bincount(row, value * w[column], len(rows))))
            g = np.bincount(column, value * (p - labels)[row], len(buckets)) / len(rows) + decay * w
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        return Scorer(buckets, w)

    def score(self, rows: list[dict[int, float]]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        if not len(self.buckets):
            return np.full(len(rows), 0.5)
        bucket = np.fromiter((b for r in rows for b in r), dtype=np.int64, count=sizes.sum())
        value = np.fromiter((v for r in rows for v in r.values()), dtype=float, count=sizes.sum())
        at = np.searchsorted(self.buckets, bucket).clip(max=len(self.buckets) - 1)
        part = np.where(self.buckets[at] == bucket, value * self.weights[at], 0.0)
        return 1 / (1 + np.exp(-np.clip(np.bincount(np.repeat(np.arange(len(rows)), sizes), part, len(rows)), -40, 40)))


@dataclass
class QualityModel:
    labels: LabelModel
    scorer: Scorer


def fit(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> QualityModel:
    """Label model from all documents, scorer from ``sample`` of them."""
    ensure_importable(docs.sparkSession)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({"pattern": pa.array([pattern(votes(statistics(t)[0])) for t in texts], pa.int32())})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                seen = [statistics(t) for t in texts]
                found = [features(*x) for x in seen]
                yield pa.RecordBatch.from_pydict(
                    {
                        "h": rows.column("h"),
                        "pattern": pa.array([pattern(votes(x[0])) for x in seen], pa.int32()),
                        "buckets": pa.array([list(x) for x in found], pa.list_(pa.int32())),
                        "shares": pa.array([list(x.values()) for x in found], pa.list_(pa.float32())),
                    }
                )

    # The hash is of the text alone, so the same texts give the same model whatever
    # columns stand beside them. Copies count as one: partial aggregation leaves one of
    # them in each task.
    texts = docs.select(F.xxhash64(f"`{text_col}`").alias("h"), F.col(f"`{text_col}`").alias("text"))
    counts = {r.pattern: r.n for r in texts.select("text").mapInArrow(look, "pattern int").groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).collect()}
    labels = LabelModel.fit(counts)
    chosen = bounded_sample(texts, sum(counts.values()), sample, F.col("h"), whole=True).groupBy("h").agg(F.any_value("text").alias("text")).limit(sample)
    taken = chosen.mapInArrow(learn, "h bigint, pattern int, buckets array<int>, shares array<float>").toArrow().sort_by("h")
    rows = [dict(zip(b, v, strict=True)) for b, v in zip(taken.column("buckets").to_pylist(), taken.column("shares").to_pylist(), strict=True)]
    if not rows:
        return QualityModel(labels, Scorer(np.zeros(0, dtype=np.int64), np.zeros(0)))
    target = labels.posterior(np.array([unpattern(p) for p in taken.column("pattern").to_pylist()]))
    return QualityModel(labels, Scorer.fit(rows, target))


def judge(docs: DataFrame, model: QualityModel, text_col: str = "text", keep: float = KEEP) -> DataFrame:
    """``docs`` with ``quality_label`` (posterior of its votes), ``quality_score``
    (the scorer's) and ``kept``."""
    shared = broadcast_value(docs.sparkSession, model)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: QualityModel = shared.value
        for batch in batches:
            for rows, texts in text_slices(batch, text_col, "row"):
                seen = [statistics(t) for t in texts]
                score = held.scorer.score([features(*x) for x in seen])
                label = held.labels.posterior(np.array([votes(x[0]) for x in seen]))
                yield pa.RecordBatch.from_pydict({"row": rows.column("row"), "quality_label": pa.array(label), "quality_score": pa.array(score), "kept": pa.array(score >= keep)})

    out = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, quality_label double, quality_score double, kept boolean")
    added = ("quality_label", "quality_score", "kept")
    return out.select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *added)


def keep_good(docs: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> DataFrame:
    """``docs`` without those that the scorer rejects."""
    clash = {c: f"__own_{c}" for c in ("quality_label", "quality_score", "kept") if c in docs.columns}
    judged = judge(docs.withColumnsRenamed(clash), fit(docs, text_col, sample), text_col)
    return judged.where("kept").select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    return judge(docs, fit(docs)).select("doc_id", "quality_label", "quality_score", "kept")
