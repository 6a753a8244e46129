"""SimHash near-dedup by a binary trie self-join (operator 7).

A text's fingerprint has a bit set where more than half of its shingles' hashes
have it. Fingerprints that differ in at most ``radius`` bits link, and linked
documents form groups.

Only distinct fingerprints are joined. Two that link agree on some choice of
blocks of their bits (pigeonhole), so every choice gives a key, and the rows of a
key form a binary trie. Pairs of its nodes are walked down together with the
number of differing bits so far: a pair over the budget is dropped, and so is a
pair whose leaves are known to be one component, which keeps a large group of
near copies from being multiplied out. Small pairs of nodes are compared leaf by
leaf. Each key emits its components as stars (fewer edges than leaves), and the
stars of all keys are joined by ``components``. The number of blocks follows the
number of fingerprints, so keys stay small; any choice of it finds all links.

Cases: a text without words (null, empty, blank) has fingerprint zero, which
links like any other; one with fewer words than a shingle is a single shingle.
Repeated rows and copies share a fingerprint and so a component; rows of one id with
different texts are separate nodes. ``component_id`` is the smallest id of the group;
null ids don't count, and a group of null ids only has a null one. Very long texts are
fingerprinted whole; an empty table gives no rows. Only id and text are read, so extra
columns can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbit.llm.common import materialize, space_words, text_slices
from quillbit.llm.components import components
from quillbit.session import ensure_importable, load

SHINGLE, RADIUS, SEED = 3, 3, 42
#: Fingerprints that a random key should hold at most; node pairs with at most so
#: many leaf pairs are compared directly; node pairs and leaf pairs held at a time.
KEY_ROWS, LEAF_PAIRS, FRONTIER = 64, 64, 1 << 18
#: Rows that a task joins at a time; a key of more than TASK_ROWS is divided first.
CHUNK_ROWS, TASK_ROWS = 1 << 18, 1 << 14


# Fingerprints


def shingle_hashes(text: bytes | None, size: int = SHINGLE) -> list[int]:
    words = space_words(text)
    if not words:
        return []
    hashed = xxhash.xxh64_intdigest
    if len(words) <= size:
        return [hashed(b" ".join(words), SEED)]
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    return [hashed(line[a:b], SEED) for a, b in zip(starts, (ends - 1)[size - 1 :].tolist(), strict=False)]


def fingerprints(texts: list[bytes | None], size: int = SHINGLE) -> np.ndarray:
    """Unsigned 64-bit fingerprints; zero without words."""
    out = np.zeros(len(texts), dtype=np.uint64)
    hashes: list[int] = []
    starts, owners = [], []
    for i, t in enumerate(texts):
        own = shingle_hashes(t, size)
        if own:
            starts.append(len(hashes))
            owners.append(i)
            hashes += own
    if not hashes:
        return out
    bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
    sizes = np.diff([*starts, len(hashes)])
    packed = np.packbits(2 * counts > sizes[:, None], axis=1, bitorder="little")
    out[owners] = np.ascontiguousarray(packed).view("<u8").ravel()
    return out


def fingerprint_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE) -> DataFrame:
    """(id, h, fp): a 64-bit hash of the text, and the fingerprint as a signed bigint."""
    ensure_importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({"id": rows.column("id"), "h": rows.column("h"), "fp": pa.array(fingerprints(texts, size).view(np.int64))})

    id_type = docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("h"), text.alias("text")).mapInArrow(run, f"id {id_type}, h bigint, fp bigint")


# The trie join


class Labels:
    """Components of leaves, by smallest index."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            x, y = self.of[a], self.of[b]
            differ = x != y
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while not np.array_equal(up := self.of[self.of], self.of):
                self.of = up

    def breaks(self) -> np.ndarray:
        """Prefix counts of label changes: a range [lo, hi) is one component if
        breaks[hi - 1] == breaks[lo]."""
        return np.concatenate(([0], np.cumsum(self.of[1:] != self.of[:-1])))


def trie_components(values: np.ndarray, groups: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For fingerprints sorted by group and value, distinct within a group: the
    index of the first member of each one's component in its group."""
    n = len(values)
    labels = Labels(n)
    starts = np.flatnonzero(np.concatenate(([True], groups[1:] != groups[:-1])))
    ends = np.concatenate((starts[1:], [n]))
    big = ends - starts > 1
    root = np.stack([starts[big], ends[big], starts[big], ends[big], np.zeros(big.sum(), dtype=np.int64)])
    stack = [(0, root)]
    ones: dict[int, np.ndarray] = {}
    while stack:
        depth, pairs = stack.pop()
        if pairs.shape[1] > FRONTIER:
            stack += [(depth, pairs[:, FRONTIER:]), (depth, pairs[:, :FRONTIER])]
            continue
        a_lo, a_hi, b_lo, b_hi, error = pairs
        breaks, of = labels.breaks(), labels.of
        same = (breaks[a_hi - 1] == breaks[a_lo]) & (breaks[b_hi - 1] == breaks[b_lo]) & (of[a_lo] == of[b_lo])
        pairs = pairs[:, ~same]
        small = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= LEAF_PAIRS
        if depth == 64:
            small[:] = True
        _compare(values, labels, pairs[:, small], radius)
        pairs = pairs[:, ~small]
        if not pairs.shape[1]:
            continue
        if depth not in ones:
            ones[depth] = np.concatenate(([0], np.cumsum((values >> np.uint64(63 - depth)) & np.uint64(1), dtype=np.int64)))
        count = ones[depth]
        a_lo, a_hi, b_lo, b_hi, error = pairs
        a_mid, b_mid = a_hi - (count[a_hi] - count[a_lo]), b_hi - (count[b_hi] - count[b_lo])
        itself = a_lo == b_lo
        lows = np.stack([a_lo, a_mid, b_lo, b_mid, error])
        highs = np.stack([a_mid, a_hi, b_mid, b_hi, error])
        cross = np.stack([a_lo, a_mid, b_mid, b_hi, error + 1])
        other = np.stack([a_mid, a_hi, b_lo, b_mid, error + 1])[:, ~itself]
        for crossing, found in ((True, np.concatenate([cross, other], axis=1)), (False, np.concatenate([lows, highs], axis=1))):
            found = found[:, (found[0] < found[1]) & (found[2] < found[3]) & (found[4] <= radius)]
            if not crossing:
                found = found[:, (found[0] != found[2]) | (found[1] - found[0] > 1)]
            if found.shape[1]:
                stack.append((depth + 1, found))  # a node with itself comes off first
    return labels.of


def _compare(values: np.ndarray, labels: Labels, pairs: np.ndarray, radius: int) -> None:
    """Leaf by leaf, so many pairs at a time."""
    sizes = (pairs[1] - pairs[0]) * (pairs[3] - pairs[2])
    cuts = np.searchsorted(np.cumsum(sizes), np.arange(FRONTIER, sizes.sum() + FRONTIER, FRONTIER), side="right")
    at = 0
    for cut in [*dict.fromkeys(cuts.tolist()), len(sizes)]:
        cut = max(cut, at + 1) if at < len(sizes) else cut
        part, own = pairs[:, at:cut], sizes[at:cut]
        at = cut
        if not len(own):
            continue
        within = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
        width = np.repeat(part[3] - part[2], own)
        a, b = np.repeat(part[0], own) + within // width, np.repeat(part[2], own) + within % width
        a, b = a[a != b], b[a != b]
        near = np.bitwise_count(values[a] ^ values[b]) <= radius
        labels.link(a[near], b[near])


def block_masks(n: int, radius: int = RADIUS) -> list[int]:
    """Masks of the block choices for ``n`` fingerprints: the bits are cut into
    blocks, and any ``radius`` of them may differ."""
    blocks = radius + 1
    while blocks < 12 and n / 2 ** (64 * (blocks - radius) / blocks) > KEY_ROWS:
        blocks += 1
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(x) for x in combinations(parts, blocks - radius)]


def linked(nodes: DataFrame, count: int, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints ``nodes`` (fp) that connect what
    links of at most ``radius`` bits connect."""
    masks = block_masks(count, radius)
    keyed = nodes.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_int64(m))) for m in masks])).alias("choice", "key"))
    large = materialize(keyed.groupBy("choice", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > TASK_ROWS).select("choice", "key"), "trie-keys")
    if large.isEmpty():
        return _joined(keyed, radius)
    # What is left of the bits is cut into twice as many blocks as bits may differ, so
    # two fingerprints that link agree on half of them.
    further = F.array(*[F.array(*[F.lit(_int64(m | x)) for x in _halves(((1 << 64) - 1) ^ m, radius)]) for m in masks])
    divided = keyed.join(large, ["choice", "key"]).select("fp", "choice", F.posexplode(F.get(further, F.col("choice"))).alias("part", "mask"))
    parts = divided.select((F.col("choice") * 1000 + F.col("part")).alias("choice"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"), "fp")
    return _joined(keyed.join(large, ["choice", "key"], "left_anti"), radius).union(_joined(parts, radius))


def _int64(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _halves(bits: int, radius: int) -> list[int]:
    """Masks of half of the 2 * radius blocks that the bits are cut into."""
    places = [i for i in range(64) if bits >> i & 1]
    blocks = 2 * radius
    parts = [sum(1 << i for i in places[len(places) * k // blocks : len(places) * (k + 1) // blocks]) for k in range(blocks)]
    return [sum(x) for x in combinations(parts, radius)]


def _joined(keyed: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) within each (choice, key) of the rows (choice, key, fp)."""
    keyed = keyed.select("choice", "key", "fp").repartition("choice", "key").sortWithinPartitions("choice", "key", "fp")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size, full = 0, CHUNK_ROWS
        for batch in batches:
            held.append(np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("choice", "key", "fp")]))
            size += batch.num_rows
            if size >= full:
                rows = np.concatenate(held, axis=1)
                last = np.flatnonzero((rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1]))
                cut = int(last[-1]) + 1 if len(last) else 0
                if cut:
                    yield from solve(rows[:, :cut])
                held, size = [rows[:, cut:]], rows.shape[1] - cut
                full = max(CHUNK_ROWS, 2 * size)
        if size:
            yield from solve(np.concatenate(held, axis=1))

    def solve(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.concatenate(([True], (rows[0, 1:] != rows[0, :-1]) | (rows[1, 1:] != rows[1, :-1])))
        group, values = np.cumsum(new), rows[2].view(np.uint64) if rows[2].flags.c_contiguous else rows[2].copy().view(np.uint64)
        order = np.lexsort((values, group))
        values, group = values[order], group[order]
        first = trie_components(values, group, radius)
        own = np.flatnonzero(first != np.arange(len(first)))
        yield pa.RecordBatch.from_pydict({"u": pa.array(values[own].view(np.int64)), "v": pa.array(values[first[own]].view(np.int64))})

    return keyed.mapInArrow(join, "u bigint, v bigint")


def _grouped(docs: DataFrame, id_col: str, text_col: str, size: int, radius: int, jaccard: bool) -> tuple[DataFrame, DataFrame]:
    """The fingerprints (id, h, fp) of all rows, and for each distinct one (fp, root,
    component, first): its group, the smallest id there, and the id and text hash of
    the group's first row (null if all ids are)."""
    prints = materialize(fingerprint_table(docs, id_col, text_col, size), "fingerprints")
    first = F.min(F.when(F.col("id").isNotNull(), F.struct("id", "h")))
    nodes = materialize(prints.groupBy("fp").agg(first.alias("first")), "nodes")
    stars = components(linked(nodes.select("fp"), nodes.count(), radius))
    rooted = nodes.join(stars, nodes.fp == stars.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    if jaccard:
        from quillbit.llm.minhash import jaccard_roots

        rooted = materialize(rooted, "node-roots")
        own = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(f"`{text_col}`").alias("h"), F.col(f"`{text_col}`").alias("text"))
        texts = own.join(rooted.where("first is not null").select("first.id", "first.h", "fp"), ["id", "h"]).dropDuplicates(["id", "h"]).select(F.col("fp").alias("id"), "text")
        further = jaccard_roots(texts, rooted.select(F.col("fp").alias("id"), "root"))
        rooted = rooted.drop("root").join(further, rooted.fp == further.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    rooted = materialize(rooted, "node-roots")
    groups = rooted.groupBy("root").agg(F.min("first").alias("first"))
    # Written, so that the join below shuffles both of its sides itself and Spark can
    # split the key of a large group of copies.
    whole = rooted.drop("first").join(groups, "root").select("fp", "root", F.col("first.id").alias("component"), "first")
    return prints, materialize(whole, "node-components")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS, jaccard: bool = True) -> DataFrame:
    """(id_col, fp, component_id) for every document. With ``jaccard``, texts that
    share 0.8 or more of their five-word shingles are in one group too; without,
    groups are those of the fingerprints alone."""
    prints, whole = _grouped(docs, id_col, text_col, size, radius, jaccard)
    return prints.join(whole, "fp").select(F.col("id").alias(id_col), "fp", F.col("component").alias("component_id"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group: that of the smallest id, once. Where
    texts of different groups share that id, each group keeps its own; of several texts
    with that id in one group, the one with the smallest hash stays. Rows with a null
    id can't be told apart and all stay."""
    _, whole = _grouped(docs, id_col, text_col, size, radius, True)
    best = whole.where("first is not null").select("first.id", "first.h").distinct()
    key = F.col(f"`{id_col}`")
    rows = docs.where(key.isNotNull()).select(key.alias("id"), F.xxhash64(f"`{text_col}`").alias("h"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = rows.join(best, ["id", "h"], "left_semi").dropDuplicates(["id", "h"]).select(*[F.col(f"row.`{c}`") for c in docs.columns])
    return kept.unionByName(docs.where(key.isNull()))


def query(spark, sf_dir: str) -> DataFrame:
    found = near_groups(load(spark, sf_dir, "documents"), jaccard=False)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
