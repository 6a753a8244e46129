import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quillbit.config import Config
from quillbit.operators import container as C
from quillbit.sources.files import read_containers, read_files, write_files

TEXTS = ["", "short", "Line one.\nLine two.\n" * 20, "é日本\r\n" * 30, "no newline " * 40]


def test_texts(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    for config in (Config(), Config(temperature=0.8, skip=False)):
        files = C.compress_texts(docs, "id", "text", 2, config).cache()
        found = {r.id: bytes(r.container) for r in files.collect()}
        for i, data in found.items():
            head = C.parse_text_container(data)
            assert data[:4] == b"NC05" and head["flags"] == config.flags and head["temperature"] == config.temperature
            assert sum(c["tokens"] for c in head["chunks"]) == len(TEXTS[i].encode())
        assert {r.id: r.text for r in C.decompress_texts(files.select("id", "container")).collect()} == dict(enumerate(TEXTS))


def test_bytes(spark):
    r = random.Random(4)
    data = [b"", b"A" * 200, r.randbytes(300), b"text " * 30 + r.randbytes(100) + b"more text\n" * 20 + bytes(200), bytes(5000) + b"x" * 64]
    rows = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(data)], "id long, data binary")
    files = C.compress_bytes(rows, "id", "data").cache()
    kinds = {x.id: "".join(k for k, _ in C.parse_bytes_container(bytes(x.container))["entries"]) for x in files.collect()}
    assert kinds == {0: "", 1: "T", 2: "B", 3: "TBTB", 4: "BT"}
    assert {x.id: bytes(x.data) for x in C.decompress_bytes(files.select("id", "container")).collect()} == dict(enumerate(data))


def test_either_kind_by_its_header(spark):
    rows = [(1, b"text one\n" * 30), (2, b"\xff\xfe" + b"mostly text " * 20), (3, b""), (4, None)]
    files = spark.createDataFrame([(i, None if d is None else bytearray(d)) for i, d in rows], "id long, content binary")
    config = Config(temperature=0.8, lzp=False, warmup=20, inner_cap=3)
    packed = C.compress(files, "id", "content", 2, config).cache()
    assert {r.id: r.mode for r in packed.collect()} == {1: "NC05", 2: "NC06", 3: "NC05", 4: "NC05"}
    back = C.decompress(packed.select("id", "container", "config"))
    assert sorted((r.id, None if r.content is None else bytes(r.content)) for r in back.collect()) == rows
    # Without the settings beside it, a reader is told what the header doesn't say.
    back = C.decompress(packed.select("id", "container"), Config(warmup=20, inner_cap=3))
    assert sorted((r.id, None if r.content is None else bytes(r.content)) for r in back.collect()) == rows


def test_commands(spark, tmp_path):
    from quillbit import cli

    for name, data in (("a/x.txt", b"one line\n" * 40), ("b/x.txt", b"other\r\n"), ("b/y.bin", b"\x00\xff" * 50)):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(data)
    source, coded, back = (str(tmp_path / x) for x in ("in", "coded", "back"))
    cli.main(["compress", source, coded, "--temperature", "0.9", "--no-lzp"], spark)
    cli.main(["decompress", coded, back], spark)
    files = lambda root: {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file() and not p.name.startswith(".")}
    assert files(tmp_path / "back") == files(tmp_path / "in")
    assert set(files(tmp_path / "coded")) == {"a/x.txt.nc", "b/x.txt.nc", "b/y.bin.nc"}
    report = {r.name: r for r in cli.run_benchmark(spark, source).collect()}
    assert all(r.lossless for r in report.values()) and report["b/y.bin"].mode == "NC06" and report["a/x.txt"].n_bytes == 360


def test_files_of_one_name_are_an_error(spark, tmp_path):
    rows = spark.createDataFrame([("x", bytearray(b"1")), ("x", bytearray(b"2"))], "name string, content binary")
    with pytest.raises(PySparkException):
        write_files(rows, str(tmp_path / "out"))
    assert not [p for p in (tmp_path / "out").rglob("*") if p.is_file()]
    write_files(rows.limit(1), str(tmp_path / "out"))
    with pytest.raises(PySparkException):
        write_files(rows.limit(1), str(tmp_path / "out"))
    write_files(rows.limit(1), str(tmp_path / "out"), overwrite=True)
    assert [p.name for p in (tmp_path / "out").rglob("*") if p.is_file()] == ["x"]
    with pytest.raises(PySparkException):
        write_files(spark.createDataFrame([("../x", bytearray(b"1"))], rows.schema), str(tmp_path / "out"))


def test_bad_magic(spark):
    rows = spark.createDataFrame([(bytearray(b"ABCD"),)], "container binary")
    with pytest.raises(PySparkException):
        C.check_magic(rows).collect()
    for parse in (C.parse_text_container, C.parse_bytes_container):
        with pytest.raises(ValueError):
            parse(b"ABCD")


def test_files(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.txt").write_bytes("one\r\ntwo é\n".encode())
    (source / "b.bin").write_bytes(b"\xff\xfe\x00")
    files = read_files(spark, str(source))
    found = {r.path.rsplit("/", 1)[1]: r for r in files.collect()}
    assert found["a.txt"].text == "one\r\ntwo é\n" and found["a.txt"].mode == "NC05"
    assert found["b.bin"].text is None and found["b.bin"].mode == "NC06"
    name = F.regexp_extract("path", "([^/]+)$", 1)
    texts = files.where("mode = 'NC05'").select(name.alias("id"), "text")
    packed = C.compress_texts(texts, "id", "text", 2)
    write_files(packed.select(F.col("id").alias("name"), F.col("container").alias("content")), str(tmp_path / "out"), ".nc")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a.txt.nc"]
    back = read_containers(spark, str(tmp_path / "out")).select(F.col("path").alias("id"), "container")
    restored = C.decompress_texts(back)
    write_files(restored.select(F.lit("a.txt").alias("name"), F.col("text").cast("binary").alias("content")), str(tmp_path / "restored"))
    assert (tmp_path / "restored" / "a.txt").read_bytes() == (source / "a.txt").read_bytes()


def _coded_alike(spark, configs, chunks):
    from quillbit.operators import codec_jvm
    from quillbit.operators.codec import encode_chunks

    assert codec_jvm.registered(spark)
    for config in configs:
        rows = spark.createDataFrame([(i, bytearray(d)) for i, d in enumerate(chunks)], "k long, data binary").coalesce(2)
        found = C.encode_rows(rows, config, bias=True)
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert codec_jvm.ENCODE in plan and "MapInArrow" not in plan
        plain = encode_chunks(chunks, config)
        coded = sorted(found.collect())
        assert [(x.tokens, x.bits, bytes(x.stream), x.skipped) for x in coded] == [x[:4] for x in plain]
        assert all(x.bias == y[4].tolist() for x, y in zip(coded, plain, strict=True))
        assert [bytes(x.data) for x in sorted(C.decode_rows(found.drop("bias"), config).collect())] == chunks


def test_rows_are_coded_in_the_jvm_as_by_arrays(spark):
    r = random.Random(8)
    chunks = [b"", b"x", bytes(range(256)), b"The quick brown fox.\n" * 20, bytes(r.choices(b"abc \n", k=350)), r.randbytes(200), bytes(300)]
    others = [Config(temperature=0.8), Config(temperature=0.0001), Config(adaptive_rate=0.5, temperature=1.3), Config(inner_cap=3, ngram_cap=5, lzp_cap=7), Config(lzp_least=1, lzp_order=3, ngram_order=6, warmup=5), Config(ngram_order=8, skip_bits=3.0, mixer_rate=2.0, total=1 << 16)]
    _coded_alike(spark, [Config(warmup=30).with_flags(f) for f in range(16)] + others, chunks)


def test_settings_beyond_the_jvm_are_coded_by_arrays(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    config = Config(lzp_order=9)
    files = C.compress_texts(docs, "id", "text", 2, config).cache()
    assert {r.id: r.text for r in C.decompress_texts(files).collect()} == dict(enumerate(TEXTS))


def test_bytes_that_come_late_are_coded_alike(spark):
    """Bytes first met below, between and above the known ones, on both sides of the
    steps at which odds are rescaled, and all 256 of them."""
    late = b"ab" * 60 + bytes(range(99, 255, 13)) + b"ab" * 60 + bytes(range(96, 0, -7)) + b"ba" * 60
    chunks = [late, bytes(range(255, -1, -1)) * 2, b"\x00" * 130 + b"\xff" * 5, late[:64], late[:129]]
    _coded_alike(spark, [Config(), Config(warmup=1, adaptive_rate=1 / 64), Config(warmup=1, skip=False, adaptive_rate=-0.01, total=(1 << 24) - 3)], chunks)


def test_segments_and_chunks_of_bytes_go_by_the_kernel(spark, tables, monkeypatch):
    """Without a shuffle by windows, and the same as the plans of DataFrames."""
    from quillbit.operators import container

    r, kinds = random.Random(11), [b"a", b"\n", b"plain text\n", b"\x01", b"\x04", b"\xe4\xb8\xad", bytes(range(256))]
    data = [b"", b"x", b"\xff" * 9, b"a" * 64, b"\n" * 70, b"a" * 63 + b"\x00" * 8 + b"b" * 64]
    data += [b"".join(k * r.choice([1, 7, 8, 9, 63, 64, 65, 200]) for k in r.choices(kinds, k=r.randrange(1, 12))) for _ in range(150)]
    data += [p.html.encode() for p in spark.read.parquet(f"{tables}/pages.parquet").where("html is not null").collect()]
    rows = spark.createDataFrame(list(enumerate(map(bytearray, data))), "id int, data binary").repartition(8, "id").cache()
    order = ["id", "seg_no", "part"]
    native = [(container._regions(rows).orderBy("id").collect(), container._text_parts(container._regions(rows), n).orderBy(order).collect()) for n in (1, 4, 7)]
    plan = container.compress_bytes(rows, "id", "data")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and container.codec_jvm.PARTS in plan
    monkeypatch.setattr(container.codec_jvm, "registered", lambda spark: False)
    for n, (regions, parts) in zip((1, 4, 7), native, strict=True):
        assert regions == container._regions(rows).select("id", "data", "s").orderBy("id").collect()
        assert parts == container._text_parts(container._regions(rows), n).orderBy(order).collect() and parts


def test_kernel_and_arrays_write_the_same_bytes_at_every_bound(spark):
    """Chunks with more followers than a context takes, with dropped contexts, and over
    the size up to which places are chained."""
    from quillbit.operators.codec import decode_chunks, encode_chunks
    from quillbit.operators.container import decode_rows, encode_rows

    r = random.Random(4)
    chunks = [bytes(r.choices(range(256), k=900)), b"ab" * 300 + bytes(r.choices(b"abc \n", k=900)), bytes(range(256)) * 2, b"", b"q"]
    for config in (Config(), Config(inner_cap=3, ngram_cap=40, lzp_cap=60), Config(lzp_least=2, lzp_order=3, ngram_order=8, warmup=7), Config(lzp_cap=2000)):
        rows = spark.createDataFrame(list(enumerate(map(bytearray, chunks))), "id int, data binary")
        coded = encode_rows(rows, config)
        found = sorted(coded.collect())
        assert [(x.tokens, x.bits, bytes(x.stream), x.skipped) for x in found] == [tuple(x[:4]) for x in encode_chunks(chunks, config)]
        assert [bytes(x.data) for x in sorted(decode_rows(coded.select("id", "tokens", "stream"), config).collect())] == chunks
        assert decode_chunks([(x.tokens, bytes(x.stream)) for x in found], config) == chunks
    long = (b"some words, " * 40 + bytes(r.choices(b"abcdefgh \n", k=2000))) * 14
    rows = spark.createDataFrame([(0, bytearray(long))], "id int, data binary")
    assert len(long) > 1 << 15
    by = [encode_rows(rows, Config(lzp_cap=cap)).first() for cap in (1_000_000, 1 << 30)]
    assert bytes(by[0].stream) == bytes(by[1].stream)
    back = decode_rows(encode_rows(rows, Config()).select("id", "tokens", "stream"), Config()).first()
    assert bytes(back.data) == long
