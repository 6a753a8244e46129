"""Session helpers: a tuned local session, table loading and worker imports."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Rows of an Arrow batch. Spark's default, 10,000 documents, is tens of MB on both
#: sides of a worker; kernels work off a batch in slices, so smaller ones cost nothing.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: str = "*", **conf: str) -> SparkSession:
    """A local session with UTC, AQE and few shuffle partitions; a cluster passes its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").config(
        map={
            "spark.sql.session.timeZone": "UTC",
            "spark.sql.shuffle.partitions": "8",
            "spark.sql.adaptive.enabled": "true",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        }
        | conf
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return ensure_importable(spark)


def ensure_importable(spark: SparkSession) -> SparkSession:
    """Let Python workers of a local session import this package whatever their
    working directory, and keep Arrow batches of texts small unless the session
    has its own setting. On a cluster the package comes with ``--py-files``; the
    extra path entry then names a folder that need not exist."""
    env = spark.sparkContext.environment
    have = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in have:
        env["PYTHONPATH"] = os.pathsep.join([*have, ROOT])
    if spark.conf.get(ARROW_ROWS, None) in (None, "10000"):
        spark.conf.set(ARROW_ROWS, "1000")
    return spark


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Deal rows by ``keys`` over all shuffle partitions. A given number keeps small
    inputs of costly rows from being coalesced into one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


#: Inputs under so many bytes are dealt over all cores when they are read.
SMALL_BYTES = 64 << 20


def balanced(rows: DataFrame) -> DataFrame:
    """A small file often has one row group, which a single task would read and
    work off alone. Its rows are dealt over the cores; larger inputs, which have
    row groups enough, are left as they are read."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism) if size < SMALL_BYTES else rows
