"""Toxicity by a factorization machine over hashed terms (operator 3).

A text's features are its distinct words, and those found twice, hashed; its score is
the logistic of ``bias + sum w_i + sum_{i<j} <v_i, v_j>``, so a pair of terms (an insult
and a mention of a group) counts beyond what each adds alone.

The model is fitted on the driver from at most ``sample`` labelled rows, chosen by the
hash of their id, and at most ENTRIES occurrences of kept terms in them (fewer rows, by
the same hash, if there are more). Which terms are kept is decided by aggregates over the
sample's terms: those whose share differs between the labels, and those whose share
differs among the texts that hold one of the STRONG first ones, so that the second
member of a pair enters even if it tells nothing by itself. At most ``terms`` are kept,
the clearest first. Only they reach the driver, and the broadcast model has no more rows
than that. All texts are scored whole in one scan without a shuffle.

Rows whose crc32 of the id, as text, is 0 modulo 5 are held out of the fit.
Labels, language, source and id never enter a score.

Cases: null counts as an empty text, and that scores the bias alone; a very long text is
scored whole; null labels don't count; of several labels of one id the larger half wins,
toxic on a tie; repeated rows get the same score; terms of equal weight are kept in the
order of their hashes; with no labels, or only one kind, every score is that share (0.5
without any). A null id is not held out and never labelled. An empty table gives no
rows; a column of the score's name is replaced.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbit.llm.common import bounded_sample, broadcast_value, discard, letter_words, materialize, text_slices
from quillbit.session import ensure_importable, load

#: Labelled rows that the model is fitted on, hash buckets, terms kept, factors.
SAMPLE, BUCKETS, TERMS, FACTORS = 20_000, 1 << 22, 8192, 8
#: Occurrences of kept terms in the sample at most, and at a time in the fit; its rounds.
ENTRIES, CHUNK, ROUNDS = 1 << 22, 1 << 18, 500
#: A kept term is in so many sampled texts, and its shares differ by so many
#: standard errors; so many of the clearest ones are looked at together with others.
LEAST_TEXTS, LEAST_Z, STRONG = 4, 3.0, 256
FOLDS = 5


def held_out(id_col: Column, folds: int = FOLDS, fold: int = 0) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


def term_buckets(text: bytes | None) -> list[int]:
    """Distinct hash buckets of the distinct words, and of those found twice."""
    counts = Counter(letter_words(text))
    return sorted({zlib.crc32(w) % BUCKETS for w in counts} | {zlib.crc32(b"2 " + w) % BUCKETS for w, n in counts.items() if n > 1})


@dataclass
class FactorizationMachine:
    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    @staticmethod
    def constant(n: int, positive: float, factors: int = FACTORS) -> FactorizationMachine:
        """The share of the label, without any term."""
        share = float(np.clip(positive / n, 1e-6, 1 - 1e-6)) if n else 0.5
        return FactorizationMachine(float(np.log(share / (1 - share))), np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros((0, factors)))

    @staticmethod
    def fit(row: np.ndarray, column: np.ndarray, labels: np.ndarray, buckets: np.ndarray, factors: int = FACTORS, rounds: int = ROUNDS, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> FactorizationMachine:
        """Row ``row[i]`` has the kept term ``column[i]``, in the order of rows; the
        terms are ``buckets``, sorted."""
        n, d, positive = len(labels), len(buckets), float(labels.sum())
        empty = FactorizationMachine.constant(n, positive, factors)
        if not d or not n or positive in (0, n):
            return empty
        params = [np.array([empty.bias]), np.zeros(d), np.random.default_rng(seed).normal(0, 0.05, (d, factors))]
        moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
        # Whole rows, about CHUNK occurrences at a time, which bounds what a round holds.
        cuts = np.searchsorted(row, np.unique(row[::CHUNK]))
        chunks = []
        for lo, hi in zip(cuts, [*cuts[1:], len(row)], strict=True):
            r, c = row[lo:hi], column[lo:hi]
            starts = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            order = np.argsort(c, kind="stable")
            used, col_starts = np.unique(c[order], return_index=True)
            chunks.append((r[starts], np.repeat(np.arange(len(starts)), np.diff([*starts, len(r)])), c, starts, order, used, col_starts))
        bare = np.ones(n, dtype=bool)
        bare[row] = False
        # The rarer label counts for more, by the root of the odds.
        weight = np.where(labels > 0, np.sqrt((n - positive) / positive), 1.0)
        for t in range(1, rounds + 1):
            bias, w, v = params
            grads = [np.zeros(1), decay * w / 300, decay * v]
            if bare.any():
                grads[0] += (weight[bare] * (1 / (1 + np.exp(-bias[0])) - labels[bare])).sum() / n
            for owners, place, c, starts, order, used, col_starts in chunks:
                own = v[c]
                total = np.add.reduceat(own, starts)
                square = np.bincount(place, (own * own).sum(1))
                margin = bias[0] + np.bincount(place, w[c]) + 0.5 * ((total * total).sum(1) - square)
                error = weight[owners] * (1 / (1 + np.exp(-np.clip(margin, -40, 40))) - labels[owners]) / n
                grads[0] += error.sum()
                grads[1] += np.bincount(c, error[place], d)
                pull = error[place, None] * (total[place] - own)
                grads[2][used] += np.add.reduceat(pull[order], col_starts)
            for p, g, (m, s) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                p -= rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.999**t)) + 1e-8)
        return FactorizationMachine(float(params[0][0]), buckets, params[1], params[2])

    def score(self, rows: list[list[int]]) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        margin = np.full(len(rows), self.bias)
        if len(self.buckets) and sizes.sum():
            flat = np.fromiter((b for r in rows for b in r), dtype=np.int64, count=sizes.sum())
            at = np.searchsorted(self.buckets, flat).clip(max=len(self.buckets) - 1)
            hit = self.buckets[at] == flat
            row, at = np.repeat(np.arange(len(rows)), sizes)[hit], at[hit]
            if len(at):
                v = self.factors[at]
                starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                total = np.add.reduceat(v, starts)
                margin += np.bincount(row, self.weights[at], len(rows))
                margin[row[starts]] += 0.5 * ((total * total).sum(1) - np.add.reduceat((v * v).sum(1), starts))
        return 1 / (1 + np.exp(-np.clip(margin, -40, 40)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> FactorizationMachine:
    ensure_importable(docs.sparkSession)
    key = F.col(f"`{id_col}`")
    usable = labels.where(~held_out(key) & key.isNotNull() & F.col(f"`{label_col}`").isNotNull()).groupBy(key.alias("id")).agg((F.avg(F.col(f"`{label_col}`").cast("double")) >= 0.5).cast("double").alias("label"))
    chosen = bounded_sample(usable, usable.count(), sample, F.xxhash64("id"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({"id": rows.column("id"), "label": rows.column("label"), "buckets": pa.array([term_buckets(t) for t in texts], pa.list_(pa.int32()))})

    # At most ``sample`` ids with a label: a bounded broadcast.
    texts = docs.select(key.alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id")
    id_type = docs.schema[id_col].dataType.simpleString()
    looked = texts.select("id", "label", "text").mapInArrow(terms, f"id {id_type}, label double, buckets array<int>")
    looked = materialize(looked.select(F.xxhash64("id").alias("h"), F.monotonically_increasing_id().alias("row"), "label", "buckets"), "toxicity-sample")
    model = _fit_sample(looked)
    discard(looked)
    return model


def clear_terms(looked: DataFrame, terms: int) -> dict[int, float]:
    """Buckets whose share among the rows (label, buckets) differs between the labels by
    LEAST_Z standard errors or more, with that number; at most ``terms``."""
    n, positive = looked.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if positive in (0, n):
        return {}
    share = F.col("seen") / n
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / positive + 1 / (n - positive)))
    z = F.abs(F.col("toxic") / positive - (F.col("seen") - F.col("toxic")) / (n - positive)) / error
    counted = looked.select("label", F.explode("buckets").alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("seen"), F.sum("label").alias("toxic"))
    found = counted.where(F.col("seen") >= LEAST_TEXTS).select("b", z.alias("z")).where(F.col("z") >= LEAST_Z)
    return {r.b: r.z for r in found.orderBy(F.desc("z"), "b").limit(terms).collect()}


def _fit_sample(looked: DataFrame, terms: int = TERMS) -> FactorizationMachine:
    """From the sampled rows (h, row, label, buckets)."""
    alone = clear_terms(looked, terms)
    strong = sorted(alone, key=lambda b: (-alone[b], b))[:STRONG]
    both = dict(alone)
    if strong:
        held = F.array(*[F.lit(b) for b in strong])
        for b, z in clear_terms(looked.where(F.arrays_overlap("buckets", held)), terms).items():
            both[b] = max(z, both.get(b, 0.0))
    kept = sorted(sorted(both, key=lambda b: (-both[b], b))[:terms])
    # At most ``terms`` rows: a bounded broadcast.
    places = looked.sparkSession.createDataFrame([(b, i) for i, b in enumerate(kept)], "b int, place int")
    own = looked.select("h", "row", F.explode("buckets").alias("b")).join(F.broadcast(places), "b").select("h", "row", "place")
    entries = own.count()
    if entries > ENTRIES:
        cut = F.shiftrightunsigned("h", 11) < int(0.95 * ENTRIES / entries * (1 << 53))
        looked, own = looked.where(cut), own.where(cut)
    rows = looked.select("h", "row", "label").toArrow().sort_by([("h", "ascending"), ("row", "ascending")])
    number = rows.column("row").to_numpy()
    order = np.argsort(number)
    found = own.select("row", "place").toArrow()
    row = order[np.searchsorted(number[order], found.column("row").to_numpy())].astype(np.int32)
    column = found.column("place").to_numpy()
    at = np.lexsort((column, row))
    return FactorizationMachine.fit(row[at], column[at], rows.column("label").to_numpy(), np.array(kept, dtype=np.int64))


def score(docs: DataFrame, model: FactorizationMachine, text_col: str = "text", score_col: str = "toxicity") -> DataFrame:
    """``docs`` with the score of each whole text, from 0 to 1; a column of the
    same name is replaced."""
    shared = broadcast_value(docs.sparkSession, model)
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: FactorizationMachine = shared.value
        for batch in batches:
            for rows, texts in text_slices(batch, text_col, "row"):
                yield pa.RecordBatch.from_pydict({"row": rows.column("row"), "score": pa.array(held.score([term_buckets(t) for t in texts]))})

    return packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, score double").select(*[F.col(f"row.`{c}`") for c in docs.columns if c != score_col], F.col("score").alias(score_col))


def query(spark, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, load(spark, sf_dir, "labels"))
    out = score(docs, model, score_col="score")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
