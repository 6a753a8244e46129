"""Predictors that can stand where a language model would (row kernels).

A scorer serves many sequences in step: ``probs`` gives one distribution for each of
the sequences asked for, and ``update`` tells it the tokens that followed in all that
are active. A sequence whose next step is sure isn't asked for. A scorer must be
deterministic, as encoder and decoder each run their own."""

from __future__ import annotations

from typing import Protocol

import numpy as np


class Scorer(Protocol):
    def start(self, sequences: int, vocabulary: int) -> None: ...

    def probs(self, sequences: np.ndarray) -> np.ndarray: ...

    def update(self, tokens: np.ndarray) -> None: ...


class AdaptiveUnigram:
    """The deterministic stand-in: add-one counts of what the sequence had so far."""

    def start(self, sequences: int, vocabulary: int) -> None:
        self.counts = np.ones((sequences, vocabulary))
        self.seen = 0

    def probs(self, sequences: np.ndarray) -> np.ndarray:
        return self.counts[sequences] * (1.0 / (self.seen + self.counts.shape[1]))

    def update(self, tokens: np.ndarray) -> None:
        self.counts[np.arange(len(tokens)), tokens] += 1
        self.seen += 1


class Fixed:
    """One distribution for every position, such as that of a language's bytes."""

    def __init__(self, table: np.ndarray):
        self.table = np.asarray(table, dtype=float) / np.sum(table)

    def start(self, sequences: int, vocabulary: int) -> None:
        if len(self.table) != vocabulary:
            raise ValueError("the table has another vocabulary")

    def probs(self, sequences: np.ndarray) -> np.ndarray:
        return np.repeat(self.table[None], len(sequences), axis=0)

    def update(self, tokens: np.ndarray) -> None:
        pass


def window_probs(scorer: Scorer, tokens: list[int], vocabulary: int) -> np.ndarray:
    """The distribution before each token of one sequence: (len, vocabulary)."""
    scorer.start(1, vocabulary)
    only = np.zeros(1, dtype=np.int64)
    out = np.empty((len(tokens), vocabulary))
    for i, t in enumerate(tokens):
        out[i] = scorer.probs(only)[0]
        scorer.update(np.array([t]))
    return out
