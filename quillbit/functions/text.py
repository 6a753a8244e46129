"""Column functions on texts and bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of segmentation: bytes that count as text, bytes that a text
#: tokenizer can lose, and the threshold lengths.
TEXT_BYTES = r"\t\n\r\x20-\x7E"
LOSSY_BYTES = r"\x04\x06\x13\x14\x16\x1D"
LEAST_TEXT, MOST_BRIDGE, LEAST_BINARY = 64, 8, 64
#: Fixed values of worker sizing, in MB.
RESERVED_MB, FIRST_WORKER_MB, NEXT_WORKER_MB, MOST_WORKERS = 512, 1169, 660, 8


def let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also inside nested functions,
    where a repeated expression would be computed at each mention."""
    return F.element_at(F.transform(F.array(value), use), 1)


def latin1(data: Column) -> Column:
    """One character for each byte, so that character classes see bytes."""
    return F.decode(data.cast("binary"), "ISO-8859-1")


def text_mode(data: Column) -> Column:
    """``NC05`` for valid UTF-8, ``NC06`` for other bytes."""
    return F.when(F.is_valid_utf8(data.cast("string")), "NC05").otherwise("NC06")


def format_size(n: Column) -> Column:
    """``N B``, ``N.N KB`` or ``N.NN MB``, exact ties to even."""

    def fixed(value: Column, digits: int) -> Column:
        return F.format_string(f"%.{digits}f", F.bround(value, digits))

    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1024 * 1024, F.concat(fixed(n / 1024, 1), F.lit(" KB")))
        .otherwise(F.concat(fixed(n / (1024 * 1024), 2), F.lit(" MB")))
    )


def ratio(compressed: Column, original: Column) -> Column:
    return F.when(original > 0, compressed / original).otherwise(F.lit(0.0))


def verdict(own: Column, gzip: Column) -> Column:
    """How ``own`` compares with ``gzip``; an empty baseline counts as identical."""
    share = F.format_string("%.1f", F.bround(F.abs(1 - own / gzip) * 100, 1))
    return F.when((own == gzip) | (gzip == 0), "identical").when(own < gzip, F.concat(share, F.lit("% smaller"))).otherwise(F.concat(share, F.lit("% larger")))


def worker_count(free_mb: Column) -> Column:
    """Workers that fit in so much memory: the first takes more than the others."""
    usable = free_mb - RESERVED_MB
    return F.when(usable.isNull() | (usable < FIRST_WORKER_MB), 1).otherwise(F.least(F.lit(MOST_WORKERS), 1 + F.floor((usable - FIRST_WORKER_MB) / NEXT_WORKER_MB))).cast("int")


def flags(ngram: Column, lzp: Column, adaptive: Column, skip: Column) -> Column:
    """The feature byte; skipping needs the n-gram model."""
    one = lambda c, bit: F.when(c, bit).otherwise(0)
    return one(ngram, 1).bitwiseOR(one(lzp, 2)).bitwiseOR(one(adaptive, 4)).bitwiseOR(one(skip & ngram, 8))


def header_hex(flag_byte: Column, temperature: Column, chunks: Column) -> Column:
    """The first nine bytes of a text container, as hexadecimal digits."""
    wide = lambda c, n: F.lpad(F.hex(c.cast("bigint")), n, "0")
    return F.concat(F.lit("4E433035"), wide(flag_byte, 2), wide(F.bround(temperature * 10000, 0), 4), wide(chunks, 4))
