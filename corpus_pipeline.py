"""The corpus pipeline: documents in, token ids out.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and
read again as the next stage's documents. All but the last keep the columns of
``documents``; ``n_chars`` follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbit.llm import decontaminate, line_dedup, quality_model, sentencepiece_viterbi, simhash
from quillbit.llm.common import materialize
from quillbit.session import ensure_importable, load


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier rejects go."""
    return quality_model.keep_good(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Boilerplate lines go; a document that held nothing else goes with them."""
    cleaned = line_dedup.dedup_lines(docs, counts=True)
    emptied = (F.col("lines_removed") > 0) & (F.length(F.trim("text")) == 0)
    return cleaned.where(~F.coalesce(emptied, F.lit(False))).select(*[F.length("text").cast("bigint").alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: of near fingerprints, and of
    texts that share 0.8 or more of their five-word shingles."""
    return simhash.near_dedup(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go."""
    return decontaminate.decontaminate(docs, load(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether they decode to its text."""
    out = sentencepiece_viterbi.encode_texts(docs.select("doc_id", "text"), decoded_col="decoded")
    same = F.col("decoded").eqNullSafe(F.replace("text", F.lit("▁"), F.lit(" ")))
    return out.select("doc_id", "token_ids", F.when(F.col("token_ids").isNotNull(), F.size("token_ids")).cast("bigint").alias("n_tokens"), same.alias("round_trip"))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("SentencePiece", tokens),
]

#: The label model and the piece lattice can't be written in SQL; the tests hold
#: each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(ensure_importable(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
