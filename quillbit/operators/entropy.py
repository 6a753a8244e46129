"""Entropies and quantised tables over counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillbit.functions.text import latin1

FLOOR = 1e-10


def byte_grams(docs: DataFrame, text_col: str, order: int, *keys: str) -> DataFrame:
    """(keys.., ctx, sym, n): bytes after the ``order`` bytes before them."""
    view = latin1(F.col(text_col))
    if order == 0:
        rows = docs.select(*keys, F.explode(F.split(view, "")).alias("g")).where(F.length("g") == 1)
    else:
        # Characters as an array: positions in a string would be searched from its start.
        cells = docs.select(*keys, F.filter(F.split(view, ""), lambda c: c != "").alias("v")).where(F.size("v") > order)
        gram = lambda c, i: F.concat(c, *[F.get("v", i + k) for k in range(1, order + 1)])
        rows = cells.select(*keys, F.explode(F.transform(F.slice("v", F.lit(1), F.size("v") - order), gram)).alias("g"))
    counted = rows.groupBy(*keys, "g").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.substring("g", 1, order).alias("ctx"), F.substring("g", order + 1, 1).alias("sym"), "n")


def conditional_entropy(grams: DataFrame, *keys: str) -> DataFrame:
    """(keys.., n, bits): the mean bits of a symbol given its context."""
    of_context = F.sum("n").over(Window.partitionBy(*keys, "ctx"))
    bits = -F.sum(F.col("n") * F.log2(F.col("n") / F.col("of_context"))) / F.sum("n")
    return grams.withColumn("of_context", of_context).groupBy(*keys).agg(F.sum("n").alias("n"), bits.alias("bits"))


def entropy(p: Column) -> Column:
    """Aggregate: the entropy of a distribution in rows."""
    return -F.sum(p * F.log2(p + FLOOR))


def with_temperature(rows: DataFrame, p_col: str, temperature: float, out_col: str = "p_t") -> DataFrame:
    """The distribution in rows, flattened (above 1) or sharpened (below)."""
    if temperature == 1.0:
        return rows.withColumn(out_col, F.col(p_col))
    power = F.exp(F.ln(F.col(p_col) + FLOOR) / temperature)
    whole = Window.partitionBy(F.lit(1))
    return rows.withColumn(out_col, power).withColumn(out_col, F.col(out_col) / F.sum(out_col).over(whole))


def cumulative(rows: DataFrame, symbol_col: str, p_col: str, total: int, size: int) -> DataFrame:
    """(symbol, p, lo, hi): integer counts of a small alphabet in rows. What is
    left by rounding goes to the first of the largest."""
    whole = Window.partitionBy(F.lit(1))
    rows = rows.withColumn("count", F.greatest(F.floor(F.col(p_col) * (total - size)).cast("bigint"), F.lit(0)) + 1)
    rows = rows.withColumn("rank", F.row_number().over(whole.orderBy(F.desc("count"), symbol_col))).withColumn("rest", total - F.sum("count").over(whole))
    rows = rows.withColumn("count", F.col("count") + F.when(F.col("rank") == 1, F.col("rest")).otherwise(0))
    hi = F.sum("count").over(whole.orderBy(symbol_col))
    return rows.withColumn("hi", hi).select(symbol_col, p_col, (F.col("hi") - F.col("count")).alias("lo"), "hi")
