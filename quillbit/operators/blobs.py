"""Conventional compression of binary blobs, as Arrow kernels."""

from __future__ import annotations

import gzip
import lzma

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructType

#: Fixed values of the format: method letters, and the size from which lzma is used.
RAW, GZIP, LZMA = "R", "G", "L"
LZMA_FROM = 4096


def pack_blob(data: bytes) -> tuple[str, bytes]:
    """The method and the bytes; raw where nothing is saved. The gzip member
    carries no time stamp, so equal blobs pack equally."""
    method, packed = (LZMA, lzma.compress(data)) if len(data) >= LZMA_FROM else (GZIP, gzip.compress(data, 9, mtime=0))
    return (method, packed) if len(packed) < len(data) else (RAW, data)


def unpack_blob(method: str, data: bytes) -> bytes:
    if method not in (RAW, GZIP, LZMA):
        raise ValueError(f"unknown blob method {method!r}")
    return data if method == RAW else gzip.decompress(data) if method == GZIP else lzma.decompress(data)


@F.pandas_udf(StructType().add("method", StringType()).add("data", BinaryType()))
def pack_blob_column(data: pd.Series) -> pd.DataFrame:
    packed = [pack_blob(bytes(d)) if d is not None else (None, None) for d in data]
    return pd.DataFrame({"method": [p[0] for p in packed], "data": [p[1] for p in packed]})


@F.pandas_udf(BinaryType())
def unpack_blob_column(method: pd.Series, data: pd.Series) -> pd.Series:
    return pd.Series([unpack_blob(m, bytes(d)) if d is not None else None for m, d in zip(method, data, strict=True)])


@F.pandas_udf(LongType())
def gzip_size(data: pd.Series) -> pd.Series:
    """Size under gzip at its best level."""
    return pd.Series([len(gzip.compress(bytes(d), 9, mtime=0)) if d is not None else None for d in data], dtype="Int64")
