"""The same results in DuckDB's SQL, written from the definitions."""

from __future__ import annotations

V = 49152
_TEXT = "0[9AD]|[2-6][0-9A-F]|7[0-9A-E]"
_OTHER = "0[0-8BCEF]|1[0-9A-F]|7F|[89A-F][0-9A-F]"
_LOSSY = "0[46]|1[346D]"
_WORDS = "[A-Za-z]+|[0-9]+|[^A-Za-z0-9]"


def _runs(table: str, key: str, column: str) -> str:
    return f"""
x AS (SELECT {key} AS id, regexp_extract_all(hex(encode({column})), '(?:{_TEXT})+|(?:{_OTHER})+') AS r FROM {table}),
runs AS (SELECT id, unnest(range(0, len(r))) AS run_no, unnest(r) AS run FROM x),
sized AS (SELECT id, run_no, CASE WHEN regexp_matches(run, '^(?:{_TEXT})') THEN 'T' ELSE 'B' END AS kind,
  CAST(length(run) // 2 AS BIGINT) AS len, regexp_matches(run, '^(?:[0-9A-F][0-9A-F])*(?:{_LOSSY})') AS lossy FROM runs),
placed AS (SELECT *, CAST(coalesce(sum(len) OVER (PARTITION BY id ORDER BY run_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS off FROM sized)"""


def _merge(name: str, source: str) -> str:
    return f"""
{name}_i AS (SELECT *, sum(new) OVER (PARTITION BY id ORDER BY off) AS island FROM (
  SELECT *, CASE WHEN lag(kind) OVER (PARTITION BY id ORDER BY off) = kind THEN 0 ELSE 1 END AS new FROM {source})),
{name} AS (SELECT id, any_value(kind) AS kind, min(off) AS off, CAST(sum(len) AS BIGINT) AS len, bool_or(lossy) AS lossy FROM {name}_i GROUP BY id, island)"""


def _segments(table: str, key: str, column: str) -> str:
    return f"""WITH {_runs(table, key, column)},
a AS (SELECT id, off, len, lossy, CASE WHEN kind = 'T' AND len < 64 THEN 'B' ELSE kind END AS kind FROM placed),
{_merge("b", "a")},
c AS (SELECT id, off, len, lossy, CASE WHEN kind = 'B' AND len <= 8 AND off > min(off) OVER (PARTITION BY id) AND off < max(off) OVER (PARTITION BY id) THEN 'T' ELSE kind END AS kind FROM b),
{_merge("e", "c")},
f AS (SELECT id, off, len, lossy, CASE WHEN kind = 'B' AND len < 64 AND NOT lossy AND count(*) OVER (PARTITION BY id) >= 2 THEN 'T' ELSE kind END AS kind FROM e),
{_merge("g", "f")}"""


def _cuts(n: int) -> str:
    return f"""WITH RECURSIVE d AS (SELECT doc_id AS id, text, length(text) AS n, length(text) // {n} AS size FROM documents),
c AS (
  SELECT id, text, n, size, 0 AS i, CAST(0 AS BIGINT) AS cut FROM d
  UNION ALL
  SELECT id, text, n, size, i + 1, CASE WHEN found < 0 OR found <= cut THEN cut + size ELSE found + 1 END FROM (
    SELECT *, CASE WHEN after < 0 OR after > cut + size + size // 2 THEN before ELSE after END AS found FROM (
      SELECT *, CASE WHEN instr(substr(text, cut + size + 1), chr(10)) = 0 THEN -1 ELSE cut + size + instr(substr(text, cut + size + 1), chr(10)) - 1 END AS after,
        CASE WHEN instr(substr(text, cut + 1, size), chr(10)) = 0 THEN -1 ELSE cut + length(substr(text, cut + 1, size)) - instr(reverse(substr(text, cut + 1, size)), chr(10)) END AS before
      FROM c WHERE i < {n - 1} AND n > 0))),
kept AS (SELECT id, i AS chunk_no, cut AS off, n FROM c WHERE i = 0 OR cut < n),
parts AS (SELECT id, chunk_no, off, coalesce(lead(off) OVER (PARTITION BY id ORDER BY chunk_no), n) - off AS len FROM kept)"""


_TOKENS = f"""
t AS (SELECT doc_id AS id, unnest(regexp_extract_all(text, '{_WORDS}')) AS t, unnest(range(0, len(regexp_extract_all(text, '{_WORDS}')))) AS pos FROM documents)"""


def _contexts(most: int) -> str:
    # A context is the text of the tokens before, each with its length, so that no two lists look alike.
    lags = ", ".join(f"lag(u, {k}) OVER w AS u{k}" for k in range(1, most + 1))
    ctx = ", ".join(f"CASE WHEN pos >= {k} THEN concat({', '.join(f'u{j}' for j in range(1, k + 1))}) END AS c{k}" for k in range(1, most + 1))
    return f"""{_TOKENS},
u AS (SELECT id, pos, t, {lags} FROM (SELECT *, concat(length(t), ':', t) AS u FROM t) WINDOW w AS (PARTITION BY id ORDER BY pos)),
k AS (SELECT id, pos, t, {ctx} FROM u)"""


def _ngram(order: int = 4) -> str:
    cols = ", ".join(f"row_number() OVER (PARTITION BY id, c{k}, t ORDER BY pos) - 1 AS n{k}, row_number() OVER (PARTITION BY id, c{k} ORDER BY pos) - 1 AS s{k}" for k in range(1, order + 1))
    steps, last = "", "q0"
    for k in range(1, order + 1):
        steps += f""",
q{k} AS (SELECT * REPLACE (CASE WHEN c{k} IS NOT NULL AND s{k} > 0 THEN (s{k} / (s{k} + 5.0::DOUBLE)) * n{k} / s{k} + (1 - s{k} / (s{k} + 5.0::DOUBLE)) * p ELSE p END AS p) FROM {last})"""
        last = f"q{k}"
    return f""",
q0 AS (SELECT *, row_number() OVER (PARTITION BY id, t ORDER BY pos) / (pos + {V})::DOUBLE AS p, row_number() OVER (PARTITION BY id, t ORDER BY pos) / (pos + {V})::DOUBLE AS pu, {cols} FROM k){steps}"""


def _match(source: str) -> str:
    guesses = ", ".join(f"CASE WHEN c{k} IS NOT NULL THEN lag(t) OVER (PARTITION BY id, c{k} ORDER BY pos) END" for k in range(8, 3, -1))
    return f""",
m0 AS (SELECT *, coalesce({guesses}) AS guess FROM {source}),
m AS (SELECT *, CASE WHEN guess IS NULL THEN 1 / {V}::DOUBLE WHEN guess = t THEN 0.85::DOUBLE ELSE 0.15::DOUBLE / ({V} - 1) END AS pm FROM m0)"""


_MIXED = (
    f"WITH {_contexts(8)}{_ngram()}{_match('q4')}"
    + """,
g AS (SELECT *, """
    + ", ".join(
        f"ln({w}::DOUBLE + 1e-30::DOUBLE) + 0.5::DOUBLE * coalesce(sum(CASE WHEN pos < 100 THEN 0 ELSE ln(greatest({c}, 1e-8::DOUBLE)) END) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l{j}"
        for j, (c, w) in enumerate((("pu", 0.85), ("p", 0.075), ("pm", 0.075)))
    )
    + """ FROM m),
e AS (SELECT *, exp(l0 - greatest(l0, l1, l2)) AS e0, exp(l1 - greatest(l0, l1, l2)) AS e1, exp(l2 - greatest(l0, l1, l2)) AS e2 FROM g),
mixed AS (SELECT *, e0 / (e0 + e1 + e2) AS w0, e1 / (e0 + e1 + e2) AS w1, e2 / (e0 + e1 + e2) AS w2,
  CASE WHEN pos < 100 THEN pu ELSE (e0 * pu + e1 * p + e2 * pm) / (e0 + e1 + e2) END AS px FROM e)"""
)


def _grams(order: int) -> str:
    return f"""WITH w AS (SELECT regexp_extract_all(text, '{_WORDS}') AS l FROM documents),
g AS (SELECT array_to_string(l[i : i + {order - 1}], chr(31)) AS ctx, l[i + {order}] AS tok FROM (SELECT l, unnest(range(1, len(l) - {order} + 1)) AS i FROM w WHERE len(l) > {order})),
n AS (SELECT ctx, tok, count(*) AS n FROM g GROUP BY ctx, tok)"""


def _entropy(order: int) -> str:
    return f"""WITH h AS (SELECT lang, hex(encode(text)) AS h FROM documents),
g AS (SELECT lang, substr(h, 2 * i - 1, {2 * order}) AS ctx, substr(h, 2 * i - 1 + {2 * order}, 2) AS sym FROM (SELECT lang, h, unnest(range(1, length(h) // 2 - {order} + 1)) AS i FROM h)),
n AS (SELECT lang, ctx, sym, count(*) AS n FROM g GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY lang, ctx) AS c FROM n)
SELECT lang, CAST(sum(n) AS BIGINT) AS n, round(-sum(n * log2(n / c)) / sum(n), 6) AS bits FROM s GROUP BY lang"""


_BYTES = """b AS (SELECT CAST('0x' || x AS INT) AS byte, count(*) AS n FROM (SELECT unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents) GROUP BY 1)"""
_SHARES = f"""WITH {_BYTES}, p AS (SELECT CAST(v.range AS INT) AS byte, coalesce(n, 0) / (SELECT sum(n)::DOUBLE FROM b) AS p FROM range(256) v LEFT JOIN b ON b.byte = v.range)"""

_SIZE = """CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN printf('%.1f', {n} / 1024::DOUBLE) || ' KB' ELSE printf('%.2f', {n} / 1048576::DOUBLE) || ' MB' END"""

ORACLES = {
    "byte_class_counts": f"""WITH h AS (SELECT doc_id, regexp_extract_all(hex(encode(text)), '..') AS b FROM documents)
SELECT doc_id, CAST(len(list_filter(b, lambda x: regexp_full_match(x, '{_TEXT}'))) AS BIGINT) AS n_text,
  CAST(len(list_filter(b, lambda x: NOT regexp_full_match(x, '{_TEXT}'))) AS BIGINT) AS n_binary,
  CAST(len(list_filter(b, lambda x: regexp_full_match(x, '{_LOSSY}'))) AS BIGINT) AS n_lossy FROM h""",
    "byte_histogram": f"WITH {_BYTES} SELECT byte, n FROM b",
    "byte_runs": f"WITH {_runs('documents', 'doc_id', 'text')} SELECT id, CAST(run_no AS BIGINT) AS run_no, kind, off, len FROM placed",
    "segments": _segments("documents", "doc_id", "text") + " SELECT id, row_number() OVER (PARTITION BY id ORDER BY off) - 1 AS seg_no, kind, off, len FROM g",
    "segment_summary": _segments("pages", "page_id", "html") + " SELECT kind, count(*) AS n, CAST(sum(len) AS BIGINT) AS n_bytes, max(len) AS longest FROM g GROUP BY kind",
    "mode_dispatch": "SELECT CASE WHEN doc_id % 3 = 0 THEN 'NC06' ELSE 'NC05' END AS mode, count(*) AS n FROM documents GROUP BY 1",
    "split_chunks": _cuts(4) + " SELECT id, CAST(chunk_no AS BIGINT) AS chunk_no, off, len FROM parts",
    "worker_count": """SELECT doc_id, CAST(CASE WHEN n_chars - 512 < 1169 THEN 1 ELSE least(8, 1 + (n_chars - 512 - 1169) // 660) END AS BIGINT) AS workers FROM documents""",
    "chunk_assignment": _cuts(8) + " SELECT CAST(chunk_no % 3 AS BIGINT) AS worker, count(*) AS n, CAST(sum(len) AS BIGINT) AS n_chars FROM parts GROUP BY 1",
    "token_roundtrip": f"""SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(len(regexp_extract_all(text, '{_WORDS}')) AS BIGINT) AS n_words,
  CASE WHEN strlen(text) > 0 THEN CAST('0x' || substr(hex(encode(text)), 1, 2) AS BIGINT) END AS first_byte, true AS bytes_lossless, true AS words_lossless FROM documents""",
    "settings_roundtrip": """WITH s AS (SELECT conv_id, turn, conv_id * 7 + turn AS k FROM conversations WHERE turn < 2)
SELECT conv_id, turn, (k & 7) | CASE WHEN k & 9 = 9 THEN 8 ELSE 0 END AS flags,
  CAST(CASE k % 3 WHEN 0 THEN 10000 WHEN 1 THEN 8000 ELSE 13000 END AS BIGINT) AS temperature, true AS lossless FROM s""",
    "token_counts": f"SELECT doc_id AS id, CAST(len(regexp_extract_all(text, '{_WORDS}')) AS BIGINT) AS n_tokens, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents",
    "vocab_counts": f"WITH {_TOKENS} SELECT t AS tok, count(*) AS n FROM t GROUP BY t",
    **{f"ngram{k}_counts": _grams(k) + " SELECT ctx, tok, n FROM n" for k in (1, 2, 3, 4)},
    "ngram_top64": _grams(1) + " SELECT ctx, tok, n, row_number() OVER (PARTITION BY ctx ORDER BY n DESC, tok) AS rank FROM n QUALIFY rank <= 64",
    "ngram_online_prob": f"WITH {_contexts(4)}{_ngram()} SELECT id, count(*) AS n_tokens, round(sum(-log2(p)), 4) AS bits, round(min(p), 10) AS least FROM q4 GROUP BY id",
    "lzp_prediction": f"WITH {_contexts(8)}{_match('k')} SELECT id, count(*) AS n_tokens, count(guess) AS n_guessed, count(*) FILTER (guess = t) AS n_right, round(sum(-log2(pm)), 4) AS bits FROM m GROUP BY id",
    "lzp_hit_rate": f"WITH {_contexts(8)}{_match('k')} SELECT lang, count(guess) AS n_guessed, count(*) FILTER (guess = t) AS n_right, round(count(*) FILTER (guess = t) / greatest(count(guess), 1)::DOUBLE, 6) AS hit_rate FROM m JOIN documents ON id = doc_id GROUP BY lang",
    "mixer_weights": _MIXED + " SELECT id, round(w0, 6) AS w0, round(w1, 6) AS w1, round(w2, 6) AS w2 FROM mixed QUALIFY row_number() OVER (PARTITION BY id ORDER BY pos DESC) = 1",
    "doc_code_length": _MIXED + " SELECT id, count(*) AS n_tokens, round(sum(-log2(pu)), 4) AS bits_unigram, round(sum(-log2(p)), 4) AS bits_ngram, round(sum(-log2(pm)), 4) AS bits_match, round(sum(-log2(px)), 4) AS bits_mixed FROM mixed GROUP BY id",
    "bits_per_byte": _MIXED + ", s AS (SELECT id, sum(-log2(px)) AS bits FROM mixed GROUP BY id) SELECT lang, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes, round(sum(bits) / sum(strlen(text)), 6) AS bits_per_byte FROM s JOIN documents ON id = doc_id GROUP BY lang",
    **{f"entropy_order{k}": _entropy(k) for k in (0, 1, 2)},
    "entropy_bytes": _SHARES + " SELECT round(-sum(p * log2(p + 1e-10::DOUBLE)), 6) AS bits FROM p",
    "temperature_unigram": _SHARES + ", q AS (SELECT byte, exp(ln(p + 1e-10::DOUBLE) / 0.7::DOUBLE) AS e FROM p) SELECT byte, round(e / (SELECT sum(e) FROM q), 8) AS p_t FROM q",
    "cdf_unigram": _SHARES
    + """, c AS (SELECT byte, greatest(CAST(floor(p * (16777216 - 256)) AS BIGINT), 0) + 1 AS c FROM p),
r AS (SELECT byte, c + CASE WHEN row_number() OVER (ORDER BY c DESC, byte) = 1 THEN 16777216 - (SELECT sum(c) FROM c) ELSE 0 END AS c FROM c),
s AS (SELECT byte, c, sum(c) OVER (ORDER BY byte) AS hi FROM r)
SELECT byte, CAST(hi - c AS BIGINT) AS lo, CAST(hi AS BIGINT) AS hi FROM s""",
    "size_report": """WITH h AS (SELECT source, unnest(regexp_extract_all(hex(encode(text)), '..')) AS x FROM documents),
n AS (SELECT source, x, count(*) AS n FROM h GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY source) AS c FROM n),
e AS (SELECT source, CAST(ceil(round(-sum(n * log2(n / c)) / 8, 2)) AS BIGINT) AS n_coded FROM t GROUP BY source),
s AS (SELECT source, count(*) AS n_docs, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes FROM documents GROUP BY source)
SELECT source, n_docs, n_bytes, """
    + _SIZE.format(n="n_bytes")
    + """ AS size, n_coded, CASE WHEN n_coded = n_bytes THEN 'identical' WHEN n_coded < n_bytes THEN printf('%.1f', (1 - n_coded / n_bytes::DOUBLE) * 100) || '% smaller' ELSE printf('%.1f', (n_coded / n_bytes::DOUBLE - 1) * 100) || '% larger' END AS verdict,
  round(n_coded / n_bytes::DOUBLE, 6) AS ratio FROM s JOIN e USING (source)""",
    "format_size": "WITH s AS (SELECT doc_id, n_chars * (doc_id % 512) AS n_bytes FROM documents) SELECT doc_id, n_bytes, " + _SIZE.format(n="n_bytes") + " AS size FROM s",
    "compress_verdict": """WITH s AS (SELECT doc_id, n_chars * 10 + doc_id % 3 AS own, strlen(text) * 10 + 1 AS other FROM documents)
SELECT doc_id, CASE WHEN own = other OR other = 0 THEN 'identical' WHEN own < other THEN printf('%.1f', (1 - own / other::DOUBLE) * 100) || '% smaller' ELSE printf('%.1f', (own / other::DOUBLE - 1) * 100) || '% larger' END AS verdict,
  round(CASE WHEN other > 0 THEN own / other::DOUBLE ELSE 0 END, 6) AS ratio FROM s""",
    "flags_header": """WITH s AS (SELECT doc_id, n_chars % 1000 AS n, CAST(round((0.5 + (doc_id % 8) * 0.125) * 10000) AS BIGINT) AS t, (doc_id & 7) | CASE WHEN doc_id & 9 = 9 THEN 8 ELSE 0 END AS f FROM documents)
SELECT doc_id, CAST(f AS BIGINT) AS flags, '4E433035' || printf('%02X%04X%04X', f, t, n) AS header FROM s""",
}
