"""Container files as rows: texts (NC05) and bytes (NC06).

The unit of work is the chunk: texts are split where they are read, chunks are
dealt over tasks and coded in step, and only coded streams are gathered by file.
Integers are big-endian.

    NC05  magic 4, flags u8, temperature*10000 u16, chunks u16,
          (tokens, bits, length) u32 for each chunk, streams
    NC06  magic 4, flags u8, temperature*10000 u16, version u32, entries u32,
          (kind u8, length u32) for each entry,
          method u8, length u32, blob     if any entry is binary
          for each text entry: parts u16, (tokens, bits, length) u32 each, streams

Reading takes flags and temperature from the header. The header doesn't hold the other
settings, so a table of containers carries them in ``config``; where that column is
missing, they are those given to the reader. Null texts and bytes have null containers.
Ids must be unique."""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, LongType, StringType, StructType

from quillbit.config import Config, recorded
from quillbit.functions.text import header_hex, latin1, text_mode
from quillbit.operators.blobs import pack_blob, unpack_blob
from quillbit.operators import codec_jvm
from quillbit.operators.chunks import split_chunks
from quillbit.operators.codec import decode_chunks, encode_chunks
from quillbit.operators.segments import segments
from quillbit.session import ensure_importable, spread

TEXT_MAGIC, BYTES_MAGIC, VERSION = b"NC05", b"NC06", 1
#: Chunks that a task codes at a time.
BATCH = 256
#: Columns that carry the settings of a row.
_OWN = ("flags", "temperature", "settings")


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    for i in range(0, batch.num_rows, BATCH):
        yield batch.slice(i, BATCH)


def _configs(rows: pa.RecordBatch, config: Config) -> list[Config]:
    """The settings of each row, from its own columns where it has them."""
    if not set(_OWN) <= set(rows.schema.names):
        return [config] * rows.num_rows
    return [recorded(*x, config) for x in zip(*(rows.column(c).to_pylist() for c in _OWN), strict=True)]


def _by_config(items: list, configs: list[Config], run) -> list:
    """``run`` of the items of each config, in the order of the items."""
    out: list = [None] * len(items)
    for each in dict.fromkeys(configs):
        at = [i for i, c in enumerate(configs) if c == each]
        for i, found in zip(at, run([items[i] for i in at], each), strict=True):
            out[i] = found
    return out


def _by_kernel(rows: DataFrame, config: Config, native, other) -> DataFrame:
    """``native`` of the rows whose settings the JVM kernel covers, ``other`` of the rest."""
    own = set(_OWN) <= set(rows.columns)
    if not codec_jvm.registered(rows.sparkSession) or not (own or codec_jvm.covers(config)):
        return other(rows)
    settings, covered = codec_jvm.settings_of(config, own)
    return native(rows.where(covered), settings).union(other(rows.where(~covered))) if own else native(rows, settings)


def encode_rows(chunks: DataFrame, config: Config, keep_data: bool = False, bias: bool = False) -> DataFrame:
    """(key.., tokens, bits, stream, skipped) for rows (key.., data binary); with
    ``keep_data`` the data stays beside them, with ``bias`` the final bias follows. Where the rows have the columns (flags,
    temperature, settings), these go before ``config``."""
    ensure_importable(chunks.sparkSession)
    keys = [c for c in chunks.columns if c not in _OWN and (c != "data" or keep_data)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch):
                coded = _by_config(rows.column("data").to_pylist(), _configs(rows, config), encode_chunks)
                yield pa.RecordBatch.from_pydict({k: rows.column(k) for k in keys} | {"tokens": pa.array([x[0] for x in coded], pa.int64()), "bits": pa.array([x[1] for x in coded], pa.int64()), "stream": pa.array([x[2] for x in coded], pa.binary()), "skipped": pa.array([x[3] for x in coded], pa.int64())} | ({"bias": pa.array([x[4] for x in coded], pa.list_(pa.float64()))} if bias else {}))

    schema = ", ".join(f"{k} {chunks.schema[k].dataType.simpleString()}" for k in keys)
    other = lambda rows: rows.mapInArrow(run, f"{schema}, tokens bigint, bits bigint, stream binary, skipped bigint{', bias array<double>' if bias else ''}")

    def native(rows: DataFrame, settings: Column) -> DataFrame:
        # A generator, so that no plan evaluates the kernel twice.
        coded = rows.select(*keys, F.explode(F.array(F.call_function(codec_jvm.ENCODE, "data", settings))).alias("__coded"))
        return coded.select(*keys, *[F.col(f"__coded.{c}").alias(c) for c in ("tokens", "bits", "stream", "skipped", *(("bias",) if bias else ()))])

    return _by_kernel(chunks, config, native, other)


def decode_rows(streams: DataFrame, config: Config, out: str = "data") -> DataFrame:
    """The rows with what their (tokens, stream) decode to in ``out``. Where they have
    the columns (flags, temperature, settings), these go before ``config``."""
    ensure_importable(streams.sparkSession)
    keys = [c for c in streams.columns if c not in (*_OWN, out)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch):
                coded = list(zip(rows.column("tokens").to_pylist(), rows.column("stream").to_pylist(), strict=True))
                found = _by_config(coded, _configs(rows, config), decode_chunks)
                yield pa.RecordBatch.from_pydict({k: rows.column(k) for k in keys} | {out: pa.array(found, pa.binary())})

    schema = ", ".join(f"{k} {streams.schema[k].dataType.simpleString()}" for k in keys)
    other = lambda rows: rows.mapInArrow(run, f"{schema}, {out} binary")
    return _by_kernel(streams, config, lambda rows, settings: rows.select(*keys, F.explode(F.array(F.call_function(codec_jvm.DECODE, F.col("tokens").cast("bigint"), F.col("stream"), settings))).alias(out)), other)


def _joined(column: str, field: str) -> Column:
    return F.unhex(F.array_join(F.transform(column, lambda c: F.hex(c[field])), ""))


def _entries(column: str) -> Column:
    wide = lambda c: F.lpad(F.hex(c.cast("bigint")), 8, "0")
    return F.unhex(F.array_join(F.transform(column, lambda c: F.concat(wide(c["tokens"]), wide(c["bits"]), wide(F.octet_length(c["stream"])))), ""))


def compress_texts(docs: DataFrame, id_col: str, text_col: str, chunks: int | Column = 4, config: Config = Config(), flags: Column | None = None, temperature: Column | None = None) -> DataFrame:
    """(id, container, config, n_bytes, skipped) of every text. ``flags`` and
    ``temperature`` may be columns of ``docs``, which then go before the config's."""
    settings = F.lit(json.dumps(config.as_dict()))
    own = [(F.lit(config.flags) if flags is None else flags).cast("int"), (F.lit(config.temperature) if temperature is None else temperature).cast("double")]
    key = F.struct(F.col(f"`{id_col}`").alias("id"), *[c.alias(n) for c, n in zip(own, _OWN, strict=False)])
    texts = docs.where(F.col(f"`{text_col}`").isNotNull()).withColumn("__key", key)
    split = split_chunks(texts, "__key", text_col, chunks).select("id", "chunk_no", F.col("chunk").cast("binary").alias("data"))
    coded = encode_rows(spread(split, "id", "chunk_no").select("*", "id.flags", "id.temperature", settings.alias("settings")), config)
    files = coded.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "tokens", "bits", "stream"))).alias("c"), F.sum("tokens").alias("n_bytes"), F.sum("skipped").alias("skipped"))
    head = F.unhex(header_hex(F.col("id.flags"), F.col("id.temperature"), F.size("c")))
    written = files.select("id.id", F.concat(head, _entries("c"), _joined("c", "stream")).alias("container"), settings.alias("config"), "n_bytes", "skipped")
    return written.union(_nulls(docs, id_col, text_col).select("id", F.lit(None).cast("binary"), settings, F.lit(None).cast("bigint"), F.lit(None).cast("bigint")))


def _nulls(docs: DataFrame, id_col: str, column: str) -> DataFrame:
    return docs.where(F.col(f"`{column}`").isNull()).select(F.col(f"`{id_col}`").alias("id"))


def parse_text_container(data: bytes) -> dict:
    if data[:4] != TEXT_MAGIC:
        raise ValueError("not a text container")
    flags, temperature, n = struct.unpack(">BHH", data[4:9])
    at, out = 9 + 12 * n, []
    for i in range(n):
        tokens, bits, size = struct.unpack(">III", data[9 + 12 * i : 21 + 12 * i])
        out.append({"chunk_no": i, "tokens": tokens, "bits": bits, "stream": data[at : at + size]})
        at += size
    return {"flags": flags, "temperature": temperature / 10_000, "chunks": out}


_CODED = {"tokens": LongType(), "bits": LongType(), "stream": BinaryType()}


def _struct(**fields) -> StructType:
    out = StructType()
    for name, kind in fields.items():
        out.add(name, kind)
    return out



@F.pandas_udf(_struct(flags=IntegerType(), temperature=DoubleType(), chunks=ArrayType(_struct(chunk_no=IntegerType(), **_CODED))))
def text_parts(data: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_text_container(bytes(d)) for d in data], columns=["flags", "temperature", "chunks"])


def check_magic(containers: DataFrame, column: str = "container") -> DataFrame:
    """The rows; reading one that is no container raises."""
    magic = F.substring(F.col(column), 1, 4)
    known = F.col(column).isNull() | (magic == F.lit(TEXT_MAGIC)) | (magic == F.lit(BYTES_MAGIC))
    return containers.withColumn(column, F.when(known, F.col(column)).otherwise(F.raise_error(F.lit("not a container")).cast("binary")))


def _settings(files: DataFrame) -> Column:
    return (F.col("config") if "config" in files.columns else F.lit(None).cast("string")).alias("settings")


def decompress_texts(files: DataFrame, config: Config = Config()) -> DataFrame:
    """(id, text) of containers (id, container[, config])."""
    whole = files.where(F.col("container").isNotNull()).select("id", text_parts("container").alias("x"), _settings(files))
    parts = whole.select("id", "settings", "x.flags", "x.temperature", F.explode("x.chunks").alias("c")).select("id", "settings", "flags", "temperature", "c.chunk_no", "c.tokens", "c.stream")
    done = decode_rows(spread(parts, "id", "chunk_no"), config)
    texts = done.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "data"))).alias("c"))
    return texts.select("id", _joined("c", "data").cast("string").alias("text")).union(_nulls(files, "id", "container").select("id", F.lit(None).cast("string")))


# Bytes


def pack_bytes_container(config: Config, entries: list[tuple[str, int]], blob: bytes | None, texts: dict[int, list[dict]]) -> bytes:
    """``entries``: (kind, length) in order; ``texts``: the coded parts by entry."""
    out = [BYTES_MAGIC, struct.pack(">BHII", config.flags, round(config.temperature * 10_000), VERSION, len(entries))]
    out += [struct.pack(">BI", ord(kind), size) for kind, size in entries]
    if blob is not None:
        method, packed = pack_blob(blob)
        out.append(struct.pack(">BI", ord(method), len(packed)) + packed)
    for i, (kind, _) in enumerate(entries):
        if kind == "T":
            parts = texts[i]
            out.append(struct.pack(">H", len(parts)) + b"".join(struct.pack(">III", p["tokens"], p["bits"], len(p["stream"])) for p in parts) + b"".join(p["stream"] for p in parts))
    return b"".join(out)


def parse_bytes_container(data: bytes) -> dict:
    if data[:4] != BYTES_MAGIC:
        raise ValueError("not a bytes container")
    flags, temperature, version, n = struct.unpack(">BHII", data[4:15])
    if version != VERSION:
        raise ValueError(f"unknown version {version}")
    at = 15
    entries = []
    for _ in range(n):
        kind, size = struct.unpack(">BI", data[at : at + 5])
        entries.append((chr(kind), size))
        at += 5
    blob, parts = b"", []
    if any(kind == "B" for kind, _ in entries):
        method, size = struct.unpack(">BI", data[at : at + 5])
        blob = unpack_blob(chr(method), data[at + 5 : at + 5 + size])
        at += 5 + size
    for i, (kind, _) in enumerate(entries):
        if kind != "T":
            continue
        (count,) = struct.unpack(">H", data[at : at + 2])
        heads = [struct.unpack(">III", data[at + 2 + 12 * k : at + 14 + 12 * k]) for k in range(count)]
        at += 2 + 12 * count
        for k, (tokens, bits, size) in enumerate(heads):
            parts.append({"seg_no": i, "part": k, "tokens": tokens, "bits": bits, "stream": data[at : at + size]})
            at += size
    return {"flags": flags, "temperature": temperature / 10_000, "entries": entries, "blob": blob, "parts": parts}


def _regions(rows: DataFrame) -> DataFrame:
    """(id, data, s) with the segments of the data, by the JVM kernel where there is one."""
    if codec_jvm.registered(rows.sparkSession):
        return rows.select("id", "data", F.call_function(codec_jvm.REGIONS, "data").alias("s"))
    regions = segments(rows, "id", "data").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seg_no", "kind", "off", "len"))).alias("s"))
    return rows.join(regions, "id", "left").withColumn("s", F.coalesce("s", F.expr(f"cast(array() as {codec_jvm.SEGMENTS})")))


def _text_parts(cut: DataFrame, parts: int) -> DataFrame:
    """(id, seg_no, part, data) of the chunks of each text segment."""
    if codec_jvm.registered(cut.sparkSession):
        return cut.select("id", F.explode(F.call_function(codec_jvm.PARTS, "data", F.lit(parts))).alias("p")).select("id", "p.*")
    texts = cut.select("id", F.explode(F.filter("s", lambda s: s["kind"] == "T")).alias("t"), "data").select(F.struct("id", "t.seg_no").alias("key"), latin1(F.substring(F.col("data"), (F.col("t.off") + 1).cast("int"), F.col("t.len").cast("int"))).alias("text"))
    return split_chunks(texts, "key", "text", parts).select("id.id", "id.seg_no", F.col("chunk_no").alias("part"), F.encode("chunk", "ISO-8859-1").alias("data"))


def compress_bytes(data: DataFrame, id_col: str, bytes_col: str, parts: int = 4, config: Config = Config()) -> DataFrame:
    """(id, container, config, n_bytes) of every byte string."""
    every = data.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{bytes_col}`").cast("binary").alias("data"))
    found = every.where("data is not null")
    cut = _regions(found)
    coded = encode_rows(spread(_text_parts(cut, parts), "id", "seg_no", "part"), config).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seg_no", "part", "tokens", "bits", "stream"))).alias("c"))
    piece = lambda s: F.substring(F.col("data"), (s["off"] + 1).cast("int"), s["len"].cast("int"))
    blob = F.unhex(F.array_join(F.transform(F.filter("s", lambda s: s["kind"] == "B"), lambda s: F.hex(piece(s))), ""))
    heads = cut.select("id", F.col("s"), blob.alias("blob"), F.octet_length("data").cast("bigint").alias("n_bytes"))

    @F.pandas_udf("binary")
    def pack(s: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for regions_, blob_, coded_ in zip(s, b, c, strict=True):
            by: dict[int, list[dict]] = {}
            for p in coded_ if coded_ is not None else []:
                by.setdefault(p["seg_no"], []).append(p)
            entries = [(r["kind"], int(r["len"])) for r in regions_]
            out.append(pack_bytes_container(config, entries, bytes(blob_) if any(k == "B" for k, _ in entries) else None, by))
        return pd.Series(out)

    settings = F.lit(json.dumps(config.as_dict())).alias("config")
    written = heads.join(coded, "id", "left").select("id", pack("s", "blob", "c").alias("container"), settings, "n_bytes")
    return written.union(_nulls(every, "id", "data").select("id", F.lit(None).cast("binary"), settings, F.lit(None).cast("bigint")))


_PARSED = _struct(flags=IntegerType(), temperature=DoubleType(), kinds=ArrayType(StringType()), sizes=ArrayType(LongType()), blob=BinaryType(), parts=ArrayType(_struct(seg_no=IntegerType(), part=IntegerType(), **_CODED)))


@F.pandas_udf(_PARSED)
def bytes_parts(data: pd.Series) -> pd.DataFrame:
    found = [parse_bytes_container(bytes(d)) for d in data]
    return pd.DataFrame({"flags": [x["flags"] for x in found], "temperature": [x["temperature"] for x in found], "kinds": [[k for k, _ in x["entries"]] for x in found], "sizes": [[n for _, n in x["entries"]] for x in found], "blob": [x["blob"] for x in found], "parts": [x["parts"] for x in found]})


def decompress_bytes(files: DataFrame, config: Config = Config()) -> DataFrame:
    """(id, data) of containers (id, container[, config]): text entries decoded, binary
    ones cut from the blob, in the order of the entries."""
    parsed = files.where(F.col("container").isNotNull()).select("id", _settings(files), bytes_parts("container").alias("x")).select("id", "settings", "x.*")
    parts = parsed.select("id", "settings", "flags", "temperature", F.explode("parts").alias("p")).select("id", "settings", "flags", "temperature", "p.seg_no", "p.part", "p.tokens", "p.stream")
    texts = decode_rows(spread(parts, "id", "seg_no", "part"), config).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("seg_no", "part", "data"))).alias("t"))

    @F.pandas_udf("binary")
    def rebuild(kinds: pd.Series, sizes: pd.Series, blob: pd.Series, texts_: pd.Series) -> pd.Series:
        out = []
        for k, n, b, t in zip(kinds, sizes, blob, texts_, strict=True):
            by: dict[int, bytes] = {}
            for p in t if t is not None else []:
                by[p["seg_no"]] = by.get(p["seg_no"], b"") + bytes(p["data"])
            at, whole = 0, []
            for i, (kind, size) in enumerate(zip(k, n, strict=True)):
                if kind == "T":
                    whole.append(by.get(i, b""))
                else:
                    whole.append(bytes(b)[at : at + size])
                    at += size
            out.append(b"".join(whole))
        return pd.Series(out)

    done = parsed.join(texts, "id", "left").select("id", rebuild("kinds", "sizes", "blob", "t").alias("data"))
    return done.union(_nulls(files, "id", "container").select("id", F.lit(None).cast("binary")))


# Either


def compress(files: DataFrame, id_col: str, content_col: str, chunks: int | Column = 4, config: Config = Config()) -> DataFrame:
    """(id, container, config, n_bytes, mode) of every file's bytes: a text container for
    valid UTF-8, a bytes container for all else, which ``mode`` says."""
    rows = files.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{content_col}`").cast("binary").alias("content"))
    mode = text_mode(F.col("content"))
    texts = rows.where(F.col("content").isNull() | (mode == "NC05")).select("id", F.col("content").cast("string").alias("text"))
    out = ["id", "container", "config", "n_bytes"]
    first = compress_texts(texts, "id", "text", chunks, config).select(*out, F.lit("NC05").alias("mode"))
    parts = chunks if isinstance(chunks, int) else 4
    return first.union(compress_bytes(rows.where(F.col("content").isNotNull() & (mode == "NC06")), "id", "content", parts, config).select(*out, F.lit("NC06").alias("mode")))


def decompress(files: DataFrame, config: Config = Config()) -> DataFrame:
    """(id, content, mode) of containers (id, container[, config]) of either kind, told
    apart by their magic; any other raises."""
    checked = check_magic(files)
    kind = F.substring(F.col("container"), 1, 4)
    texts = decompress_texts(checked.where(F.col("container").isNull() | (kind == F.lit(TEXT_MAGIC))), config)
    data = decompress_bytes(checked.where(kind == F.lit(BYTES_MAGIC)), config)
    return texts.select("id", F.col("text").cast("binary").alias("content"), F.lit("NC05").alias("mode")).union(data.select("id", "data", F.lit("NC06")))
