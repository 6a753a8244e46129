"""Compress, restore or compare whole folders of files: ``python -m quillbit``."""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillbit.config import Config
from quillbit.functions.text import format_size, ratio, verdict
from quillbit.operators.blobs import gzip_size
from quillbit.operators.container import compress, decompress
from quillbit.session import local_session
from quillbit.sources.files import read_containers, write_files
from quillbit.staging import stage

SUFFIX = ".nc"


def options(parser: argparse.ArgumentParser) -> None:
    """The settings of the model; a container records them."""
    own = Config()
    for name in ("ngram", "lzp", "adaptive", "skip"):
        parser.add_argument(f"--no-{name}", dest=name, action="store_false")
    parser.add_argument("--ngram-order", type=int, default=own.ngram_order)
    parser.add_argument("--lzp-order", type=int, default=own.lzp_order)
    parser.add_argument("--mixer-rate", type=float, default=own.mixer_rate)
    parser.add_argument("--adaptive-rate", type=float, default=own.adaptive_rate)
    parser.add_argument("--skip-bits", type=float, default=own.skip_bits)
    parser.add_argument("--warmup", type=int, default=own.warmup)
    parser.add_argument("--temperature", type=float, default=own.temperature)
    parser.add_argument("--chunks", type=int, default=4, help="parts of a file that are coded side by side")


SETTINGS = ("ngram", "lzp", "adaptive", "skip", "ngram_order", "lzp_order", "mixer_rate", "adaptive_rate", "skip_bits", "warmup", "temperature")


def _below(root: str) -> Column:
    """A file's path below ``root``, or its name if ``root`` is the file."""
    top = root.rstrip("/").removeprefix("file:").replace("//", "/")
    plain = F.regexp_replace(F.col("path"), "^[a-z]+:/*", "/")
    return F.when(F.startswith(plain, F.lit(top + "/")), F.substr(plain, F.lit(len(top) + 2))).otherwise(F.regexp_extract("path", "([^/]+)$", 1))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(_below(path).alias("id"), "content")


def run_compress(spark: SparkSession, source: str, target: str, config: Config = Config(), chunks: int = 4, overwrite: bool = False) -> DataFrame:
    """Containers of all files below ``source``, and a report (name, mode, n_bytes,
    n_coded, size, ratio). Flags and temperature are in the headers; whoever changes
    another setting passes it to ``run_decompress`` too."""
    files = stage(compress(_files(spark, source), "id", "content", chunks, config), "containers")
    write_files(files.select(F.col("id").alias("name"), F.col("container").alias("content")), target, SUFFIX, overwrite)
    size = F.octet_length("container").cast("bigint")
    return files.select(F.col("id").alias("name"), "mode", "n_bytes", size.alias("n_coded"), format_size(size).alias("size"), F.round(ratio(size, F.col("n_bytes")), 6).alias("ratio"))


def run_decompress(spark: SparkSession, source: str, target: str, config: Config = Config(), overwrite: bool = False) -> DataFrame:
    """The files of all containers below ``source``, and (name, mode, n_bytes)."""
    found = read_containers(spark, source).select(F.regexp_replace(_below(source), r"\.nc$", "").alias("id"), "container")
    files = stage(decompress(found, config), "restored")
    write_files(files.select(F.col("id").alias("name"), "content"), target, overwrite=overwrite)
    return files.select(F.col("id").alias("name"), "mode", F.octet_length("content").cast("bigint").alias("n_bytes"))


def run_benchmark(spark: SparkSession, source: str, config: Config = Config(), chunks: int = 4) -> DataFrame:
    """(name, mode, n_bytes, n_coded, n_gzip, verdict, bits_per_byte, lossless) of all
    files below ``source``."""
    own = _files(spark, source)
    files = stage(compress(own, "id", "content", chunks, config), "containers")
    back = decompress(files.select("id", "container", "config")).select("id", F.col("content").alias("back"))
    size, gzip = F.octet_length("container").cast("bigint"), gzip_size("content")
    rows = files.join(own, "id").join(back, "id")
    bits = F.when(F.col("n_bytes") > 0, F.round(8 * size / F.col("n_bytes"), 4))
    return rows.select(F.col("id").alias("name"), "mode", "n_bytes", size.alias("n_coded"), gzip.alias("n_gzip"), verdict(size, gzip).alias("verdict"), bits.alias("bits_per_byte"), (F.col("content") == F.col("back")).alias("lossless"))


def main(words: Sequence[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillbit", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("compress", "decompress", "benchmark"):
        command = commands.add_parser(name)
        command.add_argument("source", help="a file or folder")
        if name != "benchmark":
            command.add_argument("target", help="a folder that all executors share")
            command.add_argument("--overwrite", action="store_true")
        options(command)
    given = parser.parse_args(words)
    config = Config(**{k: getattr(given, k) for k in SETTINGS})
    spark = spark or local_session()
    if given.command == "compress":
        report = run_compress(spark, given.source, given.target, config, given.chunks, given.overwrite)
    elif given.command == "decompress":
        report = run_decompress(spark, given.source, given.target, config, given.overwrite)
    else:
        report = run_benchmark(spark, given.source, config, given.chunks)
    report.orderBy("name").show(1000, truncate=False)
