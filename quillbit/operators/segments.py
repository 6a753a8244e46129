"""Text and binary regions of byte strings, set-based.

Runs of one class alternate after each merge, so "between two text runs" is
"neither first nor last", and no step depends on an earlier decision. All windows
and groups are by document, so the whole chain runs on one shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillbit.functions.text import LEAST_BINARY, LEAST_TEXT, LOSSY_BYTES, MOST_BRIDGE, TEXT_BYTES, latin1
from quillbit.session import spread


def byte_runs(data: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """(id, run_no, kind, off, len, lossy): maximal runs of one byte class."""
    runs = F.regexp_extract_all(latin1(F.col(bytes_col)), F.lit(f"[{TEXT_BYTES}]+|[^{TEXT_BYTES}]+"), F.lit(0))
    out = data.select(F.col(id_col).alias("id"), F.posexplode(runs).alias("run_no", "run"))
    kind = F.when(F.col("run").rlike(f"^[{TEXT_BYTES}]"), "T").otherwise("B")
    out = out.select("id", "run_no", kind.alias("kind"), F.length("run").cast("bigint").alias("len"), F.col("run").rlike(f"[{LOSSY_BYTES}]").alias("lossy"))
    before = Window.partitionBy("id").orderBy("run_no").rowsBetween(Window.unboundedPreceding, -1)
    return out.withColumn("off", F.coalesce(F.sum("len").over(before), F.lit(0).cast("bigint")))


def _merge(runs: DataFrame) -> DataFrame:
    order = Window.partitionBy("id").orderBy("off")
    new = F.coalesce((F.lag("kind").over(order) != F.col("kind")).cast("int"), F.lit(1))
    return runs.withColumn("new", new).withColumn("island", F.sum("new").over(order)).groupBy("id", "island").agg(F.first("kind").alias("kind"), F.min("off").alias("off"), F.sum("len").alias("len"), F.bool_or("lossy").alias("lossy"))


def segments(data: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """(id, seg_no, kind, off, len): short text becomes binary, small gaps inside
    text are bridged, and what binary is short and safe is absorbed."""
    runs = byte_runs(spread(data, id_col), id_col, bytes_col).drop("run_no")
    runs = _merge(runs.withColumn("kind", F.when((F.col("kind") == "T") & (F.col("len") < LEAST_TEXT), "B").otherwise(F.col("kind"))))
    whole = Window.partitionBy("id")
    inside = (F.col("off") > F.min("off").over(whole)) & (F.col("off") < F.max("off").over(whole))
    runs = _merge(runs.withColumn("inside", inside).withColumn("kind", F.when((F.col("kind") == "B") & F.col("inside") & (F.col("len") <= MOST_BRIDGE), "T").otherwise(F.col("kind"))).drop("inside"))
    several = F.count(F.lit(1)).over(whole) >= 2
    absorbed = (F.col("kind") == "B") & (F.col("len") < LEAST_BINARY) & ~F.col("lossy") & F.col("several")
    runs = _merge(runs.withColumn("several", several).withColumn("kind", F.when(absorbed, "T").otherwise(F.col("kind"))).drop("several"))
    return runs.select("id", (F.row_number().over(Window.partitionBy("id").orderBy("off")) - 1).alias("seg_no"), "kind", "off", "len")
