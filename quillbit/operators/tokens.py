"""Lossless tokenizers as columns, and counts of tokens and n-grams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbit.functions.text import latin1

WORD_CLASS = "[A-Za-z]+|[0-9]+|[^A-Za-z0-9]"


def word_tokens(text: Column) -> Column:
    """Runs of ASCII letters, runs of digits, and any other single character."""
    return F.regexp_extract_all(text, F.lit(WORD_CLASS), F.lit(0))


def byte_tokens(text: Column) -> Column:
    """The UTF-8 bytes, as numbers."""
    return F.transform(F.filter(F.split(latin1(text), ""), lambda c: c != ""), lambda c: F.ascii(c))


def text_of_bytes(tokens: Column) -> Column:
    """The text of its bytes as numbers."""
    return F.unhex(F.array_join(F.transform(tokens, lambda t: F.lpad(F.hex(t.cast("bigint")), 2, "0")), "")).cast("string")


def text_of_words(tokens: Column) -> Column:
    return F.array_join(tokens, "")


def token_counts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.size(word_tokens(F.col(text_col))).cast("bigint").alias("n_tokens"), F.octet_length(text_col).cast("bigint").alias("n_bytes"))


def vocabulary(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.explode(word_tokens(F.col(text_col))).alias("tok")).groupBy("tok").agg(F.count(F.lit(1)).alias("n"))


def ngram_counts(docs: DataFrame, text_col: str, order: int) -> DataFrame:
    """(ctx, tok, n): how often ``tok`` followed the ``order`` tokens ``ctx``. The
    grams of a text are made within its row, so only counts are shuffled."""
    grams = F.transform(F.sequence(F.lit(1), F.size("t") - order), lambda i: F.struct(F.array_join(F.slice("t", i, F.lit(order)), "\x1f").alias("ctx"), F.element_at("t", i + order).alias("tok")))
    rows = docs.select(word_tokens(F.col(text_col)).alias("t")).where(F.size("t") > order).select(F.explode(grams).alias("g"))
    return rows.groupBy("g.ctx", "g.tok").agg(F.count(F.lit(1)).alias("n")).select("ctx", "tok", "n")


def ngram_top(counts: DataFrame, keep: int = 64) -> DataFrame:
    """The most frequent continuations of each context, ties by token."""
    order = Window.partitionBy("ctx").orderBy(F.desc("n"), "tok")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
