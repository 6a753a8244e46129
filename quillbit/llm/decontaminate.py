"""Benchmark decontamination (operator 2).

Test items become a hash set of normalised word windows, which every task holds;
the texts are scanned once, without a shuffle. Each candidate window is found by
a rolling 64-bit hash over word numbers and then verified against the words
themselves. Hit spans, or whole documents, are removed.

The set is broadcast in blocks of about ``block_bytes`` of item text, which take some
six times that in memory: a larger benchmark takes several scans, each over all
documents, and no block is left out.

Cases: a null or empty text has no words and no hits; a very long text is scanned
whole, as one slice; repeated rows each get their own result, and repeated items count
once; an item without words matches nothing; an item with fewer
words than a window is one window of its own length; null item ids are written
as ``null``; an empty benchmark leaves every document clean. Only the id and text
columns are read for matching, so extra columns of any name pass through
``decontaminate`` untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbit.llm.common import broadcast_value, letter_words, materialize, text_slices
from quillbit.session import load

WINDOW = 10
BLOCK_BYTES = 16 << 20

_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: The same words in a text whose capitals still stand.
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


class WindowSet:
    """Windows of test items, ready for scanning. The items are one array of word
    numbers. For each window length there are three more: the windows' hashes in order,
    where each window starts, and its item. That is 20 bytes a word, beside the
    vocabulary. A candidate is verified word by word."""

    def __init__(self, items: Iterable[tuple[object, bytes | None]], window: int = WINDOW):
        self.vocab: dict[bytes, int] = {}
        self.items: list[str] = []
        number = self.vocab.setdefault
        lines: list[np.ndarray] = []
        for item, text in items:
            words = letter_words(text)
            if words:
                self.items.append("null" if item is None else str(item))
                lines.append(np.fromiter((number(w, len(self.vocab)) for w in words), dtype=np.int32, count=len(words)))
        sizes = np.array([len(x) for x in lines], dtype=np.int64)
        self.words = np.concatenate(lines) if lines else np.zeros(0, dtype=np.int32)
        begin = np.cumsum(sizes) - sizes
        lengths = np.minimum(window, sizes)
        self.windows: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in np.unique(lengths).tolist():
            own = np.flatnonzero(lengths == n)
            counts = sizes[own] - n + 1
            start = (np.repeat(begin[own] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())).astype(np.int32 if len(self.words) < 1 << 31 else np.int64)
            item = np.repeat(own, counts).astype(np.int32)
            hashes = self._hashes(self.words, start, n)
            order = np.lexsort((item, hashes))
            hashes, start, item = hashes[order], start[order], item[order]
            # An item's window that repeats within it counts once.
            again = np.flatnonzero((hashes[1:] == hashes[:-1]) & (item[1:] == item[:-1])) + 1
            again = again[self._equal(self.words, start[again], self.words, start[again - 1], n)]
            self.windows[n] = tuple(np.delete(x, again) for x in (hashes, start, item))

    @staticmethod
    def _hashes(ids: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        h = np.zeros(len(starts), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for j in range(n):
                h = h * _PRIME + ids[starts + j].astype(np.uint64) + np.uint64(1)
        return h

    @staticmethod
    def _equal(a: np.ndarray, at: np.ndarray, b: np.ndarray, to: np.ndarray, n: int) -> np.ndarray:
        out = np.ones(len(at), dtype=bool)
        for j in range(n):
            out &= a[at + j] == b[to + j]
        return out

    def scan(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: its number of words, the merged spans ``[first, last]``
        of hit words, and the items found."""
        flat: list[bytes | None] = []
        bounds = [0]
        for t in texts:
            flat += letter_words(t)
            flat.append(None)  # no window crosses it
            bounds.append(len(flat))
        ids = np.fromiter(map(self.vocab.get, flat, repeat(-1)), dtype=np.int64, count=len(flat))
        bad = np.concatenate(([0], np.cumsum(ids < 0)))
        hits: dict[int, tuple[set[tuple[int, int]], set[int]]] = {}
        ends = np.array(bounds[1:])
        for n, (known, start, item) in self.windows.items():
            if len(ids) <= n:
                continue
            at = np.flatnonzero(bad[n:] == bad[:-n])
            h = self._hashes(ids, at, n)
            low = np.searchsorted(known, h)
            found = low < len(known)
            found[found] = known[low[found]] == h[found]
            at, low, h = at[found], low[found], h[found]
            for place, first, last in zip(at.tolist(), low.tolist(), np.searchsorted(known, h, side="right").tolist(), strict=True):
                same = np.arange(first, last)
                same = same[self._equal(self.words, start[same], ids, np.full(len(same), place), n)]
                if len(same):
                    doc = int(np.searchsorted(ends, place, side="right"))
                    spans, items = hits.setdefault(doc, (set(), set()))
                    spans.add((place - bounds[doc], place - bounds[doc] + n - 1))
                    items.update(item[same].tolist())
        out = []
        for doc in range(len(texts)):
            spans, items = hits.get(doc, (set(), set()))
            out.append((bounds[doc + 1] - bounds[doc] - 1, merge_spans(spans), sorted({self.items[i] for i in items})))
        return out


def merge_spans(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if merged and first <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(last, merged[-1][1]))
        else:
            merged.append((first, last))
    return merged


_SPANS = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
_MATCHES = "n_words bigint, spans array<struct<first: bigint, last: bigint>>, items array<string>"


def match_windows(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, inside: bool = False) -> DataFrame:
    """(id_col, n_words, spans, items) for every document: merged spans of hit
    words as word numbers, and the distinct items found, sorted as text. With
    ``inside`` the text is a field of the struct ``id_col``."""
    spark = docs.sparkSession
    # Distinct, so that copies of one item can't fill a block.
    bench = bench.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{item_text_col}`").alias("item_text")).distinct()
    total = bench.agg(F.sum(F.octet_length("item_text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    own_text = [] if inside else [F.col(f"`{text_col}`").alias("text")]
    out = docs.select(F.col(f"`{id_col}`").alias("id"), *own_text, F.lit(0).cast("bigint").alias("n_words"), F.expr("cast(array() as array<struct<first: bigint, last: bigint>>)").alias("spans"), F.expr("cast(array() as array<string>)").alias("items"))
    for block in range(blocks):
        part = bench if blocks == 1 else bench.where(F.pmod(F.xxhash64("item", "item_text"), F.lit(blocks)) == block)
        held = broadcast_value(spark, WindowSet(((r.item, r.item_text.encode() if r.item_text is not None else None) for r in part.toLocalIterator()), window))
        with_text = not inside and block < blocks - 1
        first = block == 0

        def scan(batches: Iterator[pa.RecordBatch], held=held, with_text=with_text, first=first) -> Iterator[pa.RecordBatch]:
            index: WindowSet = held.value
            for batch in batches:
                for rows, texts in text_slices(batch, text_col, "id") if inside else text_slices(batch, "text"):
                    found = index.scan(texts)
                    spans = [[{"first": a, "last": b} for a, b in x[1]] for x in found]
                    items = [x[2] for x in found]
                    if not first:
                        olds = [[(s["first"], s["last"]) for s in x] for x in rows.column("spans").to_pylist()]
                        spans = [[{"first": a, "last": b} for a, b in merge_spans([*x[1], *old])] for x, old in zip(found, olds, strict=True)]
                        items = [sorted({*x, *y}) for x, y in zip(items, rows.column("items").to_pylist(), strict=True)]
                    cols = {"id": rows.column("id")}
                    if with_text:
                        cols["text"] = rows.column("text")
                    cols |= {"n_words": pa.array([x[0] for x in found], pa.int64()), "spans": pa.array(spans, _SPANS), "items": pa.array(items, pa.list_(pa.string()))}
                    yield pa.RecordBatch.from_pydict(cols)

        id_type = docs.schema[id_col].dataType.simpleString()
        out = out.mapInArrow(scan, f"id {id_type}, " + ("text string, " if with_text else "") + _MATCHES)
        if block < blocks - 1:
            out = materialize(out, "decontaminate")
    return out.withColumnRenamed("id", id_col)


def decontaminate(docs: DataFrame, bench: DataFrame, remove: str = "document", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without contaminated documents (``remove='document'``) or with the
    hit words, and what stands between them, cut out of the texts
    (``remove='span'``). All columns stay; ``span`` changes ``text_col`` only."""
    if remove not in ("document", "span"):
        raise ValueError("remove is 'document' or 'span'")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    found = match_windows(packed, bench, "row", text_col, window=window, block_bytes=block_bytes, inside=True)
    if remove == "document":
        return found.where(F.size("spans") == 0).select("row.*")

    @F.pandas_udf("string")
    def cut(text, spans):
        return text.combine(spans, lambda t, s: cut_spans(t, [(x["first"], x["last"]) for x in s]) if t is not None and len(s) else t)

    text = F.col(f"row.`{text_col}`")
    clean = F.when(F.size("spans") > 0, cut(text, "spans")).otherwise(text)
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in docs.columns])


def cut_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans."""
    places = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for first, last in spans:
        out.append(text[at : places[first][0]])
        at = places[last][1]
    return "".join(out) + text[at:]


def query(spark, sf_dir: str) -> DataFrame:
    """The contract's row for every document."""
    found = match_windows(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM iw WHERE len(w) > 0)),
dwin AS (
  SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
hits AS (SELECT r, i, dwin.n, item_id FROM dwin JOIN win ON dwin.g = win.g AND dwin.n = win.n),
pos AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS k FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
