"""Newline-aligned chunks of texts, and their workers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbit.functions.text import let


def cuts(text: Column, chunks: Column) -> Column:
    """Starts of ``chunks`` roughly equal parts (the first is 0): a part ends after
    the newline next to its target, else after the last one before it, else at
    the target itself."""

    def made(length: Column) -> Column:
        size = F.floor(length / chunks).cast("int")
        find = lambda where, at: F.call_function("locate", F.lit("\n"), where, at) - 1

        def step(state: Column, _i: Column) -> Column:
            start, target = state["at"], state["at"] + size
            # The last newline of the part is the first of its reverse.
            before = let(F.reverse(F.substr(text, start + 1, size)), lambda part: let(find(part, F.lit(1)), lambda i: F.when(i < 0, -1).otherwise(start + F.length(part) - 1 - i)))
            found = let(find(text, target + 1), lambda after: F.when((after < 0) | (after > target + F.floor(size / 2)), before).otherwise(after))
            to = let(found, lambda f: F.when((f < 0) | (f <= start), target).otherwise(f + 1).cast("int"))
            return let(to, lambda t: F.struct(t.alias("at"), F.concat(state["cuts"], F.array(t)).alias("cuts")))

        first = F.struct(F.lit(0).alias("at"), F.array(F.lit(0)).alias("cuts"))
        return F.when((chunks <= 1) | (length == 0), F.array(F.lit(0))).otherwise(F.aggregate(F.sequence(F.lit(1), chunks - 1), first, step, lambda s: s["cuts"]))

    return let(F.length(text), made)


def split_chunks(docs: DataFrame, id_col: str, text_col: str, chunks: int | Column) -> DataFrame:
    """(id, chunk_no, off, len, chunk) of each text; empty chunks at the end go."""
    text = F.col("text")
    n = F.lit(chunks) if isinstance(chunks, int) else chunks
    cut = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), cuts(F.col(f"`{text_col}`"), n).alias("cuts"))
    kept = let(F.length(text), lambda n: F.filter("cuts", lambda c, i: (i == 0) | (c < n)))
    out = cut.withColumn("cuts", kept).select("id", "text", "cuts", F.posexplode("cuts").alias("chunk_no", "off"))
    end = F.coalesce(F.get("cuts", F.col("chunk_no") + 1), F.length(text))
    return out.select("id", "chunk_no", "off", (end - F.col("off")).alias("len"), F.substr(text, F.col("off") + 1, end - F.col("off")).alias("chunk"))


def assign(chunk_no: Column, workers: int) -> Column:
    return F.pmod(chunk_no, F.lit(workers))
