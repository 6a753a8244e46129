"""What the operators of this subpackage share: staged tables, byte-bounded
slices of Arrow batches, and word splitting."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbit.session import ensure_importable

#: Bytes of text that a Python kernel turns into words at a time. It bounds a
#: worker's memory whatever the Arrow batch size; a longer text is one slice.
SLICE_BYTES = 1 << 20


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing (tests), a local session gets a temporary
    folder; a cluster without it is an error, as executors could not read what
    others wrote."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="quillbit-")
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back. This
    cuts the lineage and survives the loss of executors, as a rerun task reads
    the files instead of repeating what led to them. The shuffle files of the write
    go with its end; otherwise they would stay until the driver's JVM collects."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillbit/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._quillbit_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that nothing will read again."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._quillbit_path)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def broadcast_value(spark: SparkSession, value: object):
    ensure_importable(spark)
    return spark.sparkContext.broadcast(value)


def text_slices(batch: pa.RecordBatch, column: str, within: str | None = None, max_bytes: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Consecutive slices of ``batch`` with about ``max_bytes`` of text each, and
    the texts as bytes (None for null); ``within`` names the struct that holds the
    column. What Arrow has freed goes back to the system after the batch."""
    whole = batch.column(within).field(column) if within else batch.column(column)
    if not pa.types.is_large_string(whole.type):
        whole = whole.cast(pa.large_string()) if not pa.types.is_string(whole.type) else whole
    raw = whole.cast(pa.large_binary() if pa.types.is_large_string(whole.type) else pa.binary())
    start = size = 0
    texts: list[bytes | None] = []
    for i in range(len(raw)):
        t = raw[i].as_py()
        if texts and size + len(t or b"") > max_bytes:
            yield batch.slice(start, len(texts)), texts
            start, size, texts = i, 0, []
        texts.append(t)
        size += len(t or b"")
    if texts:
        yield batch.slice(start, len(texts)), texts
    pa.default_memory_pool().release_unused()


#: Word bytes stay (ASCII letters in lower case), all others become spaces.
WORD_TABLE = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def letter_words(text: bytes | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case."""
    return text.translate(WORD_TABLE).split() if text else []


def space_words(text: bytes | None, lower: bool = True) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+``; ``lower`` folds A-Z only."""
    return (text.lower() if lower else text).split() if text else []


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def hash128(*parts: Column) -> tuple[Column, Column]:
    """Two independent 64-bit hashes, together a key whose collisions are out of
    reach where a single one would collide among 10^10 distinct values."""
    return F.xxhash64(*parts), F.xxhash64(F.lit("second"), *parts)


def bounded_sample(rows: DataFrame, total: int, sample: int, key: Column, whole: bool = False) -> DataFrame:
    """At most ``sample`` of ``total`` rows, chosen by a hash of ``key``; all of
    them if there are no more. Only the chosen rows leave the tasks that read
    them, so the cost of choosing doesn't grow with the number of tasks. With
    ``whole`` the caller sets the bound, after merging rows of equal keys."""
    if total <= sample:
        return rows
    cut = int(0.95 * sample / total * (1 << 53))
    chosen = rows.where(F.shiftrightunsigned(key, 11) < cut)
    return chosen if whole else chosen.limit(sample)
