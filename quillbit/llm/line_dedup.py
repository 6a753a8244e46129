"""Line dedup by distinct-site spread (operator 8).

For every distinct line (by a 128-bit hash) a HyperLogLog sketch of its sites is
merged by partial aggregation. A sketch proves a lower bound: each register in
use needs a site of its own. Lines whose bound reaches ``min_sites`` go; lines
with too few occurrences, or all from one site, stay; the lines between are
counted exactly. Decisions are therefore exact, not estimates.

A line that spreads over at least ``min_sites`` sites is removed everywhere but
in the document with the smallest id that carries it, so no wording is lost.

Cases: a null or empty text has no lines that can go; a line is compared without
its leading and trailing spaces, and only if it has ``min_words`` words; a null
site counts as none, but its documents' lines go too; a line that repeats inside
the first document stays there, and one that only documents with null ids carry
stays in all of them; repeated rows are treated alike. Extra columns
pass through; internal columns live in a nested row and cannot clash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbit.functions.text import let
from quillbit.llm.common import hash128, materialize
from quillbit.session import load

MIN_SITES = 5
MIN_WORDS = 3
#: Relative error of the sketch, which gives it so many registers. Up to PROVEN
#: registers in use, the sketch's estimate is ``round(m * ln(m / (m - used)))``.
SKETCH_ERROR = 0.2
REGISTERS = 32
PROVEN = 12


def _row_key(row_id: Column, text: Column) -> list[Column]:
    a, b = hash128(row_id, text)
    return [a.alias("k1"), b.alias("k2")]


def _lines(docs: DataFrame, id_col: str, text_col: str, site_col: str, min_words: int) -> DataFrame:
    """A narrow row per line that can go: keys of document and line, no text."""
    key = F.trim("line")
    words = F.length(key) - F.length(F.replace(key, F.lit(" "), F.lit(""))) + 1
    h1, h2 = hash128(key)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(f"`{site_col}`").alias("site"), F.col(f"`{site_col}`").isNull().alias("no_site"), *_row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.posexplode(F.split(f"`{text_col}`", "\n", -1)).alias("pos", "line"))
    return rows.where((F.length(key) > 0) & (words >= min_words)).select("k1", "k2", "doc", F.when(~F.col("no_site"), F.col("site")).alias("site"), "pos", h1.alias("h1"), h2.alias("h2"))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(h1, h2, first_doc) of the lines found on at least ``min_sites`` sites."""
    stats = materialize(
        lines.groupBy("h1", "h2").agg(F.count("site").alias("n"), F.min("site").alias("low"), F.max("site").alias("high"), F.approx_count_distinct("site", SKETCH_ERROR).alias("sketch"), F.min("doc").alias("first_doc")).where(F.col("n") >= min_sites),
        "line-stats",
    )
    many = (F.col("low") != F.col("high")) if min_sites > 1 else F.lit(True)
    sure = F.col("sketch") >= round(REGISTERS * math.log(REGISTERS / (REGISTERS - min_sites))) if min_sites <= PROVEN else F.lit(False)
    near = stats.where(many & ~sure).select("h1", "h2", "first_doc")
    exact = lines.where(F.col("site").isNotNull()).join(near, ["h1", "h2"]).groupBy("h1", "h2", "site").agg(F.first("first_doc").alias("first_doc")).groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites"), F.first("first_doc").alias("first_doc"))
    return stats.where(many & sure).select("h1", "h2", "first_doc").union(exact.where(F.col("sites") >= min_sites).select("h1", "h2", "first_doc"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", min_sites: int = MIN_SITES, min_words: int = MIN_WORDS, counts: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of the texts; ``counts`` adds
    ``lines_in`` and ``lines_removed``."""
    lines = materialize(_lines(docs, id_col, text_col, site_col, min_words), "lines")
    spread = spread_lines(lines, min_sites)
    gone = lines.join(spread, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("first_doc")))
    gone = gone.groupBy("k1", "k2").agg(F.collect_set("pos").alias("gone"))
    row = docs.select(*_row_key(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    parts = F.split(F.col(f"row.`{text_col}`"), "\n", -1)
    left = lambda p: F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("gone")))
    rest = let(parts, lambda p: F.array_join(F.transform(left(p), lambda i: F.element_at(p, i + 1)), "\n"))
    text = F.when(F.col("gone").isNull(), F.col(f"row.`{text_col}`")).otherwise(rest)
    out = row.join(gone, ["k1", "k2"], "left").select(*[text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns], *([F.coalesce(F.size(parts), F.lit(0)).cast("bigint").alias("lines_in"), F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("lines_removed")] if counts else []))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """(doc_id, n_lines, n_removed, text_md5): lines found and removed, and the
    digest of the whole text that is left (null for a null text)."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return dedup_lines(docs, counts=True).select("doc_id", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.col("lines_in")).cast("bigint").alias("n_lines"), F.greatest("lines_removed", F.lit(0)).cast("bigint").alias("n_removed"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


ORACLE = rf"""
WITH l AS (
  SELECT r, doc_id, source, line, i, trim(line) AS k
  FROM (SELECT r, doc_id, source, unnest(p) AS line, generate_subscripts(p, 1) AS i
        FROM (SELECT row_number() OVER () AS r, doc_id, source, string_split(text, chr(10)) AS p FROM documents))),
b AS (
  SELECT k, min(doc_id) AS first_doc FROM l
  WHERE length(k) > 0 AND length(k) - length(replace(k, ' ', '')) + 1 >= {MIN_WORDS}
  GROUP BY k HAVING count(DISTINCT source) >= {MIN_SITES})
SELECT l.doc_id, CAST(count(*) AS BIGINT) AS n_lines,
  CAST(count(*) FILTER (b.k IS NOT NULL AND l.doc_id <> b.first_doc) AS BIGINT) AS n_removed,
  md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (b.k IS NULL OR l.doc_id = b.first_doc), '')) AS text_md5
FROM l LEFT JOIN b ON l.k = b.k GROUP BY l.r, l.doc_id
"""
