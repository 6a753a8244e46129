"""Files in and out: raw inputs, containers, and restored files.

Reading is Spark's ``binaryFile``, so any store that Spark reads will do. Writing
goes through the ``quillbit-files`` data source: each task writes the rows that it
holds as files of a hidden folder, and the commit moves them to their names at once, so
a failed or repeated task leaves nothing behind. Names are paths below the folder; two
rows of one name, or a name that is there already, are an error before anything moves.
With ``overwrite`` a file that is there is replaced."""

from __future__ import annotations

import os
import shutil
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from quillbit.functions.text import text_mode
from quillbit.operators.container import check_magic


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, text, mode): ``text`` for valid UTF-8, with its line ends as
    they are; null for other bytes, which are read as bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content", F.try_validate_utf8(F.col("content").cast("string")).alias("text"), text_mode(F.col("content")).alias("mode"))


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """(path, container); a file without a known magic raises."""
    return check_magic(spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("content").alias("container")))


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class FileWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.path, self.suffix, self.overwrite = options["path"].removeprefix("file://"), options.get("suffix", ""), overwrite
        self.hidden = os.path.join(self.path, f".writing-{uuid.uuid4().hex}")
        if schema.names[:2] != ["name", "content"]:
            raise ValueError("the columns are name and content")

    def write(self, rows) -> Written:
        os.makedirs(self.hidden, exist_ok=True)
        done = []
        for row in rows:
            name = os.path.normpath(str(row[0]).lstrip("/")) + self.suffix
            if row[0] is None or name.startswith("..") or name == self.suffix:
                raise ValueError(f"{row[0]!r} is no name below the folder")
            part = os.path.join(self.hidden, uuid.uuid4().hex)
            with open(part, "wb") as f:
                f.write(bytes(row[1]))
            done.append((part, name))
        return Written(done)

    def commit(self, messages) -> None:
        found = [x for m in messages if m is not None for x in m.files]
        names = [name for _, name in found]
        clash = sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []
        if not self.overwrite:
            clash += sorted(n for n in set(names) if os.path.exists(os.path.join(self.path, n)))
        if clash:
            self.abort(messages)
            raise FileExistsError(f"more than one file for {clash[:5]}")
        for part, name in found:
            target = os.path.join(self.path, name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            os.replace(part, target)
        shutil.rmtree(self.hidden, ignore_errors=True)

    def abort(self, messages) -> None:
        shutil.rmtree(self.hidden, ignore_errors=True)


class FileSink(DataSource):
    """``df.write.format("quillbit-files").save(folder)`` for rows (name, content).
    The folder must be one that all executors share."""

    @classmethod
    def name(cls) -> str:
        return "quillbit-files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return FileWriter(dict(self.options), schema, overwrite)


def write_files(rows: DataFrame, folder: str, suffix: str = "", overwrite: bool = False) -> None:
    """One file for each row (name, content); null contents have none."""
    rows = rows.where(F.col("content").isNotNull())
    rows.sparkSession.dataSource.register(FileSink)
    rows.select("name", F.col("content").cast("binary").alias("content")).write.format(FileSink.name()).mode("overwrite" if overwrite else "append").option("suffix", suffix).save(folder)


__all__ = ["FileSink", "read_containers", "read_files", "write_files"]
