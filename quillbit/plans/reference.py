"""The engine's queries over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillbit.config import CDF_TOTAL, WORD_VOCABULARY, Config
from quillbit.functions import text as T
from quillbit.operators import chunks, codelength, container, entropy, online, segments, tokens
from quillbit.operators.blobs import gzip_size, pack_blob_column, unpack_blob_column
from quillbit.session import balanced, load, spread
from quillbit.staging import stage

CHUNKS, WORKERS = 4, 3
_WORDS = Config(vocabulary=WORD_VOCABULARY)


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return balanced(load(spark, d, "documents"))


def byte_class_counts(spark, d):
    view = T.latin1(F.col("text"))
    gone = lambda c: F.octet_length("text") - F.length(F.regexp_replace(view, c, ""))
    return _docs(spark, d).select("doc_id", gone(f"[{T.TEXT_BYTES}]").cast("bigint").alias("n_text"), gone(f"[^{T.TEXT_BYTES}]").cast("bigint").alias("n_binary"), gone(f"[{T.LOSSY_BYTES}]").cast("bigint").alias("n_lossy"))


def byte_histogram(spark, d):
    return entropy.byte_grams(_docs(spark, d), "text", 0).select(F.ascii("sym").alias("byte"), "n")


def byte_runs(spark, d):
    return segments.byte_runs(_docs(spark, d), "doc_id", "text").select("id", F.col("run_no").cast("bigint").alias("run_no"), "kind", "off", "len")


def segment_rows(spark, d):
    return segments.segments(_docs(spark, d), "doc_id", "text").select("id", F.col("seg_no").cast("bigint").alias("seg_no"), "kind", "off", "len")


def segment_summary(spark, d):
    rows = segments.segments(balanced(load(spark, d, "pages")), "page_id", "html")
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("n_bytes"), F.max("len").alias("longest"))


def mode_dispatch(spark, d):
    """Every third text is followed by a byte that UTF-8 doesn't have."""
    spoilt = F.when(F.col("doc_id") % 3 == 0, F.lit(b"\xff")).otherwise(F.lit(b""))
    return _docs(spark, d).groupBy(T.text_mode(F.concat(F.col("text").cast("binary"), spoilt)).alias("mode")).agg(F.count(F.lit(1)).alias("n"))


def split_chunks(spark, d):
    return chunks.split_chunks(_docs(spark, d), "doc_id", "text", CHUNKS).select("id", F.col("chunk_no").cast("bigint").alias("chunk_no"), F.col("off").cast("bigint").alias("off"), F.col("len").cast("bigint").alias("len"))


def worker_count(spark, d):
    return _docs(spark, d).select("doc_id", T.worker_count(F.col("n_chars")).cast("bigint").alias("workers"))


def chunk_assignment(spark, d):
    rows = chunks.split_chunks(_docs(spark, d), "doc_id", "text", 2 * CHUNKS)
    return rows.groupBy(chunks.assign(F.col("chunk_no"), WORKERS).cast("bigint").alias("worker")).agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("n_chars"))


def token_roundtrip(spark, d):
    """Both tokenizers, and whether their tokens give the text back."""
    of_bytes, of_words = tokens.byte_tokens(F.col("text")), tokens.word_tokens(F.col("text"))
    rows = _docs(spark, d).select("doc_id", "text", of_bytes.alias("b"), of_words.alias("w"))
    first = F.when(F.size("b") > 0, F.get("b", F.lit(0))).cast("bigint")
    return rows.select("doc_id", F.size("b").cast("bigint").alias("n_bytes"), F.size("w").cast("bigint").alias("n_words"), first.alias("first_byte"), (tokens.text_of_bytes(F.col("b")) == F.col("text")).alias("bytes_lossless"), (tokens.text_of_words(F.col("w")) == F.col("text")).alias("words_lossless"))


def token_counts(spark, d):
    return tokens.token_counts(_docs(spark, d), "doc_id", "text")


def vocab_counts(spark, d):
    return tokens.vocabulary(_docs(spark, d), "text")


def ngram_counts(order: int):
    return lambda spark, d: tokens.ngram_counts(_docs(spark, d), "text", order)


def ngram_top64(spark, d):
    return tokens.ngram_top(tokens.ngram_counts(_docs(spark, d), "text", 1)).select("ctx", "tok", "n", F.col("rank").cast("bigint").alias("rank"))


def _bits(c: str):
    return F.round(F.sum(-F.log2(F.col(c))), 4)


def ngram_online_prob(spark, d):
    rows = online.ngram_prob(online.keyed_tokens(_docs(spark, d), "doc_id", "text", 4), 4, WORD_VOCABULARY)
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_tokens"), _bits("p_ngram").alias("bits"), F.round(F.min("p_ngram"), 10).alias("least"))


def _matches(spark, d):
    rows = online.match_prob(online.keyed_tokens(_docs(spark, d), "doc_id", "text", 8), 4, 8, WORD_VOCABULARY)
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("n_tokens"), F.count("guess").alias("n_guessed"), F.count_if(F.col("guess") == F.col("t")).alias("n_right"), _bits("p_match").alias("bits"))


def lzp_prediction(spark, d):
    return _matches(spark, d)


def lzp_hit_rate(spark, d):
    rows = _matches(spark, d).join(_docs(spark, d).select(F.col("doc_id").alias("id"), "lang"), "id")
    return rows.groupBy("lang").agg(F.sum("n_guessed").alias("n_guessed"), F.sum("n_right").alias("n_right"), F.round(F.sum("n_right") / F.greatest(F.sum("n_guessed"), F.lit(1)), 6).alias("hit_rate"))


def mixer_weights(spark, d):
    rows = codelength.code_lengths(load(spark, d, "documents"), "doc_id", "text", _WORDS)
    return rows.select("id", *[F.round(f"w{j}", 6).alias(f"w{j}") for j in range(3)])


def doc_code_length(spark, d):
    """Flagship: bits of every document under each predictor and their mixture."""
    rows = codelength.code_lengths(load(spark, d, "documents"), "doc_id", "text", _WORDS)
    return rows.select("id", "n_tokens", *[F.round(c, 4).alias(c) for c in ("bits_unigram", "bits_ngram", "bits_match", "bits_mixed")])


def bits_per_byte(spark, d):
    docs = load(spark, d, "documents")
    sizes = docs.select(F.col("doc_id").alias("id"), "lang", F.octet_length("text").alias("n_bytes"))
    rows = codelength.code_lengths(docs, "doc_id", "text", _WORDS).select("id", F.col("bits_mixed").alias("bits"))
    return rows.join(sizes, "id").groupBy("lang").agg(F.sum("n_bytes").cast("bigint").alias("n_bytes"), F.round(F.sum("bits") / F.sum("n_bytes"), 6).alias("bits_per_byte"))


def entropy_order(order: int):
    def query(spark, d):
        grams = entropy.byte_grams(_docs(spark, d), "text", order, "lang")
        return entropy.conditional_entropy(grams, "lang").select("lang", "n", F.round("bits", 6).alias("bits"))

    return query


def _byte_shares(spark, d):
    counts = byte_histogram(spark, d)
    every = spark.range(256).select(F.col("id").cast("int").alias("byte"))
    # At most 256 rows: the counts of bytes.
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return every.join(counts, "byte", "left").select("byte", (F.coalesce("n", F.lit(0)) / total).alias("p"))


def entropy_bytes(spark, d):
    return _byte_shares(spark, d).agg(F.round(entropy.entropy(F.col("p")), 6).alias("bits"))


def temperature_unigram(spark, d):
    return entropy.with_temperature(_byte_shares(spark, d), "p", 0.7).select("byte", F.round("p_t", 8).alias("p_t"))


def cdf_unigram(spark, d):
    return entropy.cumulative(_byte_shares(spark, d), "byte", "p", CDF_TOTAL, 256).select("byte", "lo", "hi")


def size_report(spark, d):
    """Bytes of each source, and what an ideal code of single bytes leaves of them."""
    rows = _docs(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.octet_length("text")).cast("bigint").alias("n_bytes"))
    coded = entropy.conditional_entropy(entropy.byte_grams(_docs(spark, d), "text", 0, "source"), "source").select("source", F.ceil(F.round(F.col("n") * F.col("bits") / 8, 2)).cast("bigint").alias("n_coded"))
    own = rows.join(coded, "source")
    return own.select("source", "n_docs", "n_bytes", T.format_size(F.col("n_bytes")).alias("size"), "n_coded", T.verdict(F.col("n_coded"), F.col("n_bytes")).alias("verdict"), F.round(T.ratio(F.col("n_coded"), F.col("n_bytes")), 6).alias("ratio"))


def format_size(spark, d):
    n = F.col("n_chars") * F.pmod("doc_id", F.lit(512))
    return _docs(spark, d).select("doc_id", n.alias("n_bytes"), T.format_size(n).alias("size"))


def compress_verdict(spark, d):
    own, other = F.col("n_chars") * 10 + F.pmod("doc_id", F.lit(3)), F.octet_length("text") * 10 + 1
    return _docs(spark, d).select("doc_id", T.verdict(own, other).alias("verdict"), F.round(T.ratio(own, other), 6).alias("ratio"))


def flags_header(spark, d):
    bit = lambda k: F.pmod(F.floor(F.col("doc_id") / k), F.lit(2)) == 1
    flags = T.flags(bit(1), bit(2), bit(4), bit(8))
    temperature = 0.5 + F.pmod("doc_id", F.lit(8)) * 0.125
    return _docs(spark, d).select("doc_id", flags.cast("bigint").alias("flags"), T.header_hex(flags, temperature, F.pmod("n_chars", F.lit(1000))).alias("header"))


# Kernels: held against exact round trips


def _coded_turns(spark, d):
    turns = load(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    return container.encode_rows(spread(turns, "conv_id", "turn"), Config(), bias=True).withColumnRenamed("tokens", "n")


def adaptive_bias(spark, d):
    """The head's final bias for each turn: its extremes, and its sum, which each
    update leaves as it was."""
    total = F.aggregate("bias", F.lit(0.0), lambda a, x: a + x)
    return _coded_turns(spark, d).select("conv_id", "turn", "n", F.array_min("bias").alias("least"), F.array_max("bias").alias("most"), (F.abs(total) < 1e-9).alias("balanced"))


def confidence_skip(spark, d):
    """How many steps of each turn were sure enough to leave the scorer out."""
    return _coded_turns(spark, d).select("conv_id", "turn", "n", "skipped", "bits")


def codec_roundtrip(spark, d):
    """Each turn as one chunk: coded size, and whether decoding gives it back."""
    turns = load(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    coded = container.encode_rows(spread(turns, "conv_id", "turn"), Config(), keep_data=True)
    back = container.decode_rows(coded.select("conv_id", "turn", "data", "tokens", "stream"), Config(), "back")
    return back.select("conv_id", "turn", F.octet_length("data").cast("bigint").alias("n_bytes"), F.octet_length("stream").cast("bigint").alias("n_coded"), (F.col("data") == F.col("back")).alias("lossless"))


def settings_roundtrip(spark, d):
    """Turns written with all feature flags and three temperatures, and read by what
    their headers say."""
    number = F.col("conv_id") * 7 + F.col("turn")
    turns = load(spark, d, "conversations").where("turn < 2").select(F.struct("conv_id", "turn").alias("key"), F.coalesce("text", F.lit("")).alias("text"), number.alias("number"))
    bit = lambda k: F.pmod(F.floor(F.col("number") / k), F.lit(2)) == 1
    flags = T.flags(bit(1), bit(2), bit(4), bit(8))
    temperature = F.get(F.array(F.lit(1.0), F.lit(0.8), F.lit(1.3)), F.pmod("number", F.lit(3)).cast("int"))
    files = stage(container.compress_texts(turns, "key", "text", 2, flags=flags, temperature=temperature), "containers")
    back = container.decompress(files.select("id", "container")).select("id", F.col("content").cast("string").alias("back"))
    out = files.join(back, "id").join(turns.select(F.col("key").alias("id"), "text"), "id")
    head = lambda at, n: F.conv(F.hex(F.substring("container", at, n)), 16, 10).cast("bigint")
    return out.select("id.conv_id", "id.turn", head(5, 1).alias("flags"), head(6, 2).alias("temperature"), (F.col("text") == F.col("back")).alias("lossless"))


def blob_method(spark, d):
    pages = load(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("data"))
    packed = spread(pages, "page_id").withColumn("p", pack_blob_column("data")).withColumn("g", gzip_size("data"))
    return packed.select("page_id", F.octet_length("data").cast("bigint").alias("n_bytes"), "p.method", F.octet_length("p.data").cast("bigint").alias("n_packed"), F.col("g").alias("n_gzip"), (unpack_blob_column("p.method", "p.data") == F.col("data")).alias("lossless"))


def nc05_roundtrip(spark, d):
    docs = _docs(spark, d).select("doc_id", "text")
    # Chunks of about 2 KB: as many as keep every task's state small.
    parts = F.least(F.lit(65535), F.greatest(F.lit(1), F.ceil(F.length("text") / 2048))).cast("int")
    files = stage(container.compress_texts(docs, "doc_id", "text", parts), "containers")
    back = container.decompress_texts(files.select("id", "container")).withColumnRenamed("text", "back")
    out = files.join(back, "id").join(docs.withColumnRenamed("doc_id", "id"), "id")
    gzip = gzip_size(F.col("text").cast("binary"))
    size = F.octet_length("container")
    return out.select("id", "n_bytes", size.cast("bigint").alias("n_coded"), "skipped", T.verdict(size, gzip).alias("verdict"), (F.col("text") == F.col("back")).alias("lossless"))


def nc06_roundtrip(spark, d):
    data = load(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("data"))
    files = stage(container.compress_bytes(data, "page_id", "data"), "containers")
    back = container.decompress_bytes(files.select("id", "container")).withColumnRenamed("data", "back")
    out = files.join(back, "id").join(data.withColumnRenamed("page_id", "id"), "id")
    return out.select("id", "n_bytes", F.octet_length("container").cast("bigint").alias("n_coded"), (F.col("data") == F.col("back")).alias("lossless"))


QUERIES = {
    "byte_class_counts": byte_class_counts,
    "byte_histogram": byte_histogram,
    "byte_runs": byte_runs,
    "segments": segment_rows,
    "segment_summary": segment_summary,
    "mode_dispatch": mode_dispatch,
    "split_chunks": split_chunks,
    "worker_count": worker_count,
    "chunk_assignment": chunk_assignment,
    "token_roundtrip": token_roundtrip,
    "token_counts": token_counts,
    "vocab_counts": vocab_counts,
    **{f"ngram{k}_counts": ngram_counts(k) for k in (1, 2, 3, 4)},
    "ngram_top64": ngram_top64,
    "ngram_online_prob": ngram_online_prob,
    "lzp_prediction": lzp_prediction,
    "lzp_hit_rate": lzp_hit_rate,
    "mixer_weights": mixer_weights,
    "doc_code_length": doc_code_length,
    "bits_per_byte": bits_per_byte,
    **{f"entropy_order{k}": entropy_order(k) for k in (0, 1, 2)},
    "entropy_bytes": entropy_bytes,
    "temperature_unigram": temperature_unigram,
    "cdf_unigram": cdf_unigram,
    "size_report": size_report,
    "format_size": format_size,
    "compress_verdict": compress_verdict,
    "flags_header": flags_header,
    "adaptive_bias": adaptive_bias,
    "confidence_skip": confidence_skip,
    "codec_roundtrip": codec_roundtrip,
    "settings_roundtrip": settings_roundtrip,
    "blob_method": blob_method,
    "nc05_roundtrip": nc05_roundtrip,
    "nc06_roundtrip": nc06_roundtrip,
}
FLAGSHIP = doc_code_length
