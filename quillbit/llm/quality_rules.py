"""Quality rules as learned decision lists (operator 6).

Every text's statistics are computed by DataFrame functions where it is read.
From labelled statistics, sequential covering learns an ordered list of
conjunctions of thresholds: a rule is grown on two thirds of the rows by
information gain, pruned on the rest, and kept while it is precise there; the
rows it covers are taken away and the next rule is grown. The list becomes one
Spark conditional expression, so judging a text is a column like any other.

The rules are learned on the driver from at most ``sample`` labelled rows of
statistics; the statistics themselves are of every whole text.

Cases: null counts as an empty text, with zero statistics; texts of under ten
words, or with more than a fifth of their words in repeated windows, fail the
base check and aren't kept; repeated rows are judged alike; null labels don't
count, and of several labels of one id the larger half wins, good on a tie;
without labels, or without bad ones, no rule is learned and what passes the base
check is kept; an empty table gives no rows; very long texts are counted whole. Windows are compared by a 64-bit hash within one text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbit.llm.common import bounded_sample, materialize
from quillbit.session import load

SPACES = " \t\n\x0b\f\r"
SYMBOLS = "#*$%&|<>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5
LEAST_WORDS, MOST_REPEATED = 10, 20
#: Labelled rows that rules are learned from; rules and conditions at most; and
#: what share of the held-back rows that a rule covers must be bad.
SAMPLE, RULES, CONDITIONS, PRECISION = 20_000, 12, 4, 0.9
#: Statistics that rules may test, by name.
FEATURES = {
    "mean_chars": lambda: F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1)),
    "symbol_rate": lambda: F.col("n_symbols") / F.greatest(F.col("n_words"), F.lit(1)),
    "dup_line_rate": lambda: F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    "repeat_rate": lambda: F.col("n_repeat_words") / F.greatest(F.col("n_words"), F.lit(1)),
    "upper_rate": lambda: F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
    "exclamation_rate": lambda: F.col("n_exclamations") / F.greatest(F.col("n_words"), F.lit(1)),
}


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also inside nested functions."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _count_of(text: Column, characters: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("bigint")


def _repeated_words(words: Column) -> Column:
    """How many words lie in windows that occur twice or more."""
    n = F.size(words)

    def windows(own: Column) -> Column:
        rest = lambda i: [F.get(own, i + k) for k in range(1, WINDOW)]
        return F.transform(F.slice(own, F.lit(1), n - WINDOW + 1), lambda h, i: F.xxhash64(h, *rest(i)))

    def covered(hashes: Column) -> Column:
        placed = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def count(rows: Column) -> Column:
            near = lambda at: F.get(rows, at)["h"]
            again = F.filter(rows, lambda r, k: (F.coalesce(near(k - 1) == r["h"], F.lit(False))) | (F.coalesce(near(k + 1) == r["h"], F.lit(False))))
            starts = F.array_sort(F.transform(again, lambda r: r["i"]))
            zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
            return F.aggregate(starts, zero, lambda s, i: F.struct((i + WINDOW).alias("end"), (s["total"] + i + WINDOW - F.greatest(i, s["end"])).alias("total")), lambda s: s["total"])

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(_let(placed, count))

    hashed = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(n > WINDOW, _let(hashed, lambda own: _let(windows(own), covered))).otherwise(0).cast("bigint")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, with its statistics; columns of the same names
    are replaced."""
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], F.lit(1).alias("__one")).alias("row"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    text = F.col("text")
    words = F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+", -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    of_words = _let(words, lambda w: F.struct(F.size(w).cast("bigint").alias("n_words"), _repeated_words(w).alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")))
    own = {
        "n_words": F.col("w.n_words"),
        "word_chars": F.length(F.translate(text, SPACES, "")).cast("bigint"),
        "n_symbols": _count_of(text, SYMBOLS),
        "n_dup_lines": F.col("l.n_dup_lines"),
        "n_repeat_words": F.col("w.n_repeat_words"),
        "n_lines": F.col("l.n_lines"),
        "n_upper": _count_of(text, UPPER),
        "n_exclamations": _count_of(text, "!"),
    }
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    added = [*own, "base_failed"]
    return packed.select("row", "text", of_words.alias("w"), of_lines.alias("l")).select("row", *[c.alias(k) for k, c in own.items()]).withColumn("base_failed", failed).select(*[F.col(f"row.`{c}`") for c in docs.columns if c != text_col and c not in added], *added)


# Learning


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        return rows[self.feature] >= self.threshold if self.above else rows[self.feature] < self.threshold

    def column(self) -> Column:
        value = FEATURES[self.feature]()
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.4g}"


@dataclass(frozen=True)
class Rule:
    """All conditions hold: the text is bad."""

    conditions: tuple[Condition, ...]

    def holds(self, rows: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(rows.values()))), dtype=bool)
        for c in self.conditions:
            out &= c.holds(rows)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.column()
        return out

    def __str__(self) -> str:
        return " and ".join(map(str, self.conditions))


def _grow(rows: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """Add the condition with the most information gain until no good row is
    covered, or nothing is gained."""
    conditions: list[Condition] = []
    covered = np.ones(len(bad), dtype=bool)
    while len(conditions) < CONDITIONS and (~bad[covered]).any():
        p0, n0 = bad[covered].sum(), covered.sum()
        best, gain = None, 1e-9
        for name, values in rows.items():
            order = np.argsort(values[covered], kind="stable")
            v, b = values[covered][order], bad[covered][order]
            cuts = np.flatnonzero(np.concatenate(([False], v[1:] > v[:-1])))
            if not len(cuts):
                continue
            below = np.concatenate(([0], np.cumsum(b)))[cuts]
            for above, p, n in ((True, p0 - below, n0 - cuts), (False, below, cuts)):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gains = np.where(p > 0, p * (np.log2(p / n) - np.log2(p0 / n0)), 0.0)
                k = int(np.argmax(gains))
                if gains[k] > gain:
                    # Between two sampled values, nearer to the side that the rule covers.
                    near, far = (v[cuts[k]], v[cuts[k] - 1]) if above else (v[cuts[k] - 1], v[cuts[k]])
                    best, gain = Condition(name, above, float(near + 0.2 * (far - near))), gains[k]
        if best is None:
            break
        conditions.append(best)
        covered &= best.holds(rows)
    return Rule(tuple(conditions))


def _prune(rule: Rule, rows: dict[str, np.ndarray], bad: np.ndarray) -> tuple[Rule, float, int]:
    """The leading conditions with the best (bad - good) / covered on held-back
    rows, with their precision and cover there."""
    found = []
    for k in range(1, len(rule.conditions) + 1):
        own = Rule(rule.conditions[:k])
        hit = own.holds(rows)
        p, n = int(bad[hit].sum()), int(hit.sum())
        found.append(((2 * p - n) / n if n else -1.0, -k, own, p / n if n else 0.0, n))
    _, _, own, precision, n = max(found, key=lambda x: x[:2])
    return own, precision, n


def learn(rows: dict[str, np.ndarray], bad: np.ndarray, rules: int = RULES, precision: float = PRECISION, seed: int = 3) -> list[Rule]:
    """An ordered list of rules; each is learned from what those before leave."""
    out: list[Rule] = []
    growing = np.random.default_rng(seed).random(len(bad)) < 2 / 3
    left = np.ones(len(bad), dtype=bool)
    while len(out) < rules and bad[left & growing].any():
        take = lambda mask: ({k: v[mask] for k, v in rows.items()}, bad[mask])
        rule = _grow(*take(left & growing))
        if not rule.conditions:
            break
        rule, exact, n = _prune(rule, *take(left & ~growing))
        if n == 0 or exact < precision:
            break
        out.append(rule)
        left &= ~rule.holds(rows)
    return out


def verdict(rules: list[Rule]) -> Column:
    """True for a text that no rule calls bad, as one ordered conditional."""
    out = None
    for rule in rules:
        out = F.when(rule.column(), False) if out is None else out.when(rule.column(), False)
    return F.lit(True) if out is None else out.otherwise(True)


def learn_from(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", sample: int = SAMPLE) -> list[Rule]:
    """Rules from the labelled rows of ``stats`` that pass the base check."""
    key = F.col(f"`{id_col}`")
    usable = labels.where(key.isNotNull() & F.col(f"`{label_col}`").isNotNull()).groupBy(key.alias("id")).agg((F.avg(F.col(f"`{label_col}`").cast("double")) < 0.5).alias("bad"))
    chosen = bounded_sample(usable, usable.count(), sample, F.xxhash64("id"))
    # At most ``sample`` ids with a label: a bounded broadcast. Rows that repeat an id and
    # its statistics count once, and if there are still more than ``sample``, the hash of
    # all of that chooses among them.
    rows = stats.where(~F.col("base_failed")).select(key.alias("id"), *[c().cast("double").alias(k) for k, c in FEATURES.items()]).join(F.broadcast(chosen), "id").distinct()
    found = sorted(bounded_sample(rows, rows.count(), sample, F.xxhash64("id", *FEATURES)).collect(), key=lambda r: (str(r.id), *(r[k] for k in FEATURES)))
    rows = {k: np.array([r[k] for r in found], dtype=float) for k in FEATURES}
    return learn(rows, np.array([r.bad for r in found], dtype=bool)) if found else []


def judge(stats: DataFrame, rules: list[Rule]) -> DataFrame:
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def query(spark, sf_dir: str) -> DataFrame:
    stats = materialize(statistics(load(spark, sf_dir, "documents").select("doc_id", "text")), "quality-statistics")
    judged = judge(stats, learn_from(stats, load(spark, sf_dir, "labels")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
