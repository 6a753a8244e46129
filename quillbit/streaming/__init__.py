"""Compression of a stream of texts.

A text's container depends on nothing but the text, so a stream needs no state and
no watermark: every micro-batch is compressed as a table would be. A batch that is
run again after a failure replaces its own folder, so each text is there once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quillbit.config import Config
from quillbit.operators.container import compress_texts


def compress_stream(texts: DataFrame, id_col: str, text_col: str, out: str, checkpoint: str, chunks: int = 4, config: Config = Config()) -> StreamingQuery:
    """Start writing containers of a streaming table under ``out``, a folder
    ``batch=<n>`` for each micro-batch."""

    def write(batch: DataFrame, number: int) -> None:
        compress_texts(batch, id_col, text_col, chunks, config).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
