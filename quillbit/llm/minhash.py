"""Near-dedup by Jaccard similarity of five-word shingles, which completes the
SimHash groups in the pipeline.

MinHash bands propose pairs: two texts of similarity 0.8 share one of the BANDS
bands of ROWS minima with a chance of 99.97 %. Every pair is verified on the whole
sets of shingles, and verified pairs are joined by ``components``. A band's bucket is
worked off in steps, so that a large group of near copies makes rows in proportion to
its size:

1. All members are paired with the first one. Most of a group is then one component.
2. A member outside the bucket's largest component is an outsider. If they are at most
   NEAR, each is paired with every member of another component, which leaves no pair of
   the bucket open, as pairs of one component need no test.
3. The members of all buckets of more outsiders get new buckets by an exact prefix
   filter: one for each of the rarest fifth of a text's shingles, the rarest among
   these texts first. Two texts of similarity 0.8 share one of those. A text that has
   more shingles of its own than that is in no bucket, which spares the edited copies
   that are too far from all others. These buckets go through both steps, the second
   whatever their outsiders: blocks of them are held against the other members, which
   pass by, so that no row is made for a pair that isn't a link.

No partner is left out: what is in no band together is missed by the chance above, and
nothing else. One document of each fingerprint takes part, as the SimHash groups know
all about the others.

Cases: texts without words have no pairs; ids are bigint (the stage gives
fingerprints) and don't repeat; an empty table has no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillbit.llm.common import discard, materialize, text_slices
from quillbit.llm.components import components
from quillbit.llm.simhash import shingle_hashes
from quillbit.session import ensure_importable

SHINGLE, LEAST = 5, 0.8
BANDS, ROWS = 20, 5
NEAR = 8
#: Outsiders that a task holds at a time, and members of a bucket that pass by in a task.
HELD, PASSING = 64, 4096
_MULTIPLIER, _LAST = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def band_keys(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """(sets, bands) keys of non-empty sets of hashes."""
    random = np.random.default_rng(42)
    factors = random.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    offsets = random.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    starts = np.cumsum([0, *(len(s) for s in sets)])[:-1]
    hashes = np.concatenate(sets)
    out = np.zeros((len(sets), bands), dtype=np.uint64)
    for i in range(bands * rows):
        mixed = hashes * factors[i] + offsets[i]
        mixed ^= mixed >> np.uint64(29)
        least = np.minimum.reduceat(mixed * _LAST, starts)
        out[:, i // rows] = (out[:, i // rows] ^ least) * _MULTIPLIER + np.uint64(i)
    return out


def shingle_sets(texts: list[bytes | None]) -> list[np.ndarray]:
    return [np.unique(np.array(shingle_hashes(t, SHINGLE), dtype=np.uint64)) for t in texts]


def _bands(docs: DataFrame) -> DataFrame:
    """(id, key) for each band."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                sets = shingle_sets(texts)
                some = [i for i, s in enumerate(sets) if len(s)]
                if some:
                    keys = band_keys([sets[i] for i in some])
                    ids = rows.column("id").to_numpy()[some]
                    yield pa.RecordBatch.from_pydict({"id": pa.array(np.repeat(ids, BANDS)), "key": pa.array(keys.ravel().view(np.int64))})

    return docs.mapInArrow(run, "id bigint, key bigint")


def _shingles(docs: DataFrame) -> DataFrame:
    """(id, size, key) for each distinct shingle of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                sets = shingle_sets(texts)
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                ids = rows.column("id").to_numpy()
                yield pa.RecordBatch.from_pydict({"id": pa.array(np.repeat(ids, sizes)), "size": pa.array(np.repeat(sizes, sizes)), "key": pa.array(np.concatenate(sets).view(np.int64))})

    return docs.mapInArrow(run, "id bigint, size bigint, key bigint")


def _prefixes(docs: DataFrame, bands: DataFrame) -> DataFrame:
    """(id, key) of the prefixes of the documents in the buckets ``bands`` (id, key), but
    for shingles that a single one of them has."""
    shingles = materialize(_shingles(docs.join(bands.select("id").distinct(), "id", "left_semi")), "shingles")
    counts = shingles.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    own = Window.partitionBy("id")
    # A text's single shingles come first, and only their number matters.
    rank = F.col("size") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("n", "key"))
    # So many shingles may be missing from a text of similarity LEAST, and one more.
    length = F.col("size") - F.ceil(LEAST * F.col("size") - 1e-9) + 1
    ranked = shingles.join(counts, "key").select("id", "key", (rank <= length).alias("within"))
    out = materialize(ranked.where("within").select("id", "key"), "bands")
    discard(shingles)
    return out


def _sets(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                yield pa.RecordBatch.from_pydict({"id": rows.column("id"), "hashes": pa.array([s.tobytes() for s in shingle_sets(texts)], pa.binary())})

    return docs.mapInArrow(run, "id bigint, hashes binary")


def _similar(pairs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
                x, y = np.frombuffer(a, dtype="<u8"), np.frombuffer(b, dtype="<u8")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= LEAST * (len(x) + len(y) - both) - 1e-9)
            yield batch.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return pairs.mapInArrow(run, "u bigint, v bigint")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs (u, v) of similarity LEAST or more, on whole sets of shingles."""
    pairs = materialize(pairs.distinct(), "band-pairs")
    members = pairs.select(F.col("u").alias("id")).union(pairs.select(F.col("v").alias("id"))).distinct()
    sets = materialize(_sets(docs.join(members, "id", "left_semi")), "shingle-sets")
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("hashes").alias("b")), "v")
    found = materialize(_similar(both.select("u", "v", "a", "b")), "jaccard-edges")
    for table in (pairs, sets):
        discard(table)
    return found


def _passed(docs: DataFrame, members: DataFrame, mixed: DataFrame) -> DataFrame:
    """Links (u, v) of similarity LEAST or more between the outsiders of the buckets
    ``mixed`` (key, n, most, outside) and the ``members`` (id, key, root): at least one
    for each outsider and component that such a link connects."""
    sets = materialize(_sets(docs.join(members.join(mixed, "key", "left_semi").select("id").distinct(), "id", "left_semi")), "shingle-sets")
    parts = mixed.select("key", "most", *[F.ceil(F.col(c) / size).cast("int").alias(to) for c, size, to in (("outside", HELD, "blocks"), ("n", PASSING, "salts"))])
    rows = members.join(parts, "key")
    dealt = [F.pmod(F.xxhash64("id"), c).cast("int") for c in ("blocks", "salts")]
    every = [F.explode(F.sequence(F.lit(0), F.col(c) - 1)) for c in ("blocks", "salts")]
    held = rows.where("root <> most").select("key", dealt[0].alias("block"), every[1].alias("salt"), F.lit(0).alias("role"), "id", "root")
    passing = rows.select("key", every[0].alias("block"), dealt[1].alias("salt"), F.lit(1).alias("role"), "id", "root")
    place = ["key", "block", "salt"]
    whole = held.union(passing).join(sets, "id").select(*place, "role", "id", "root", "hashes")
    found = materialize(whole.repartition(*place).sortWithinPartitions(*place, "role").mapInArrow(_pass, "u bigint, v bigint").distinct(), "jaccard-edges")
    discard(sets)
    return found


def _pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    at, ids, roots, held = None, [], [], []
    index: tuple[np.ndarray, ...] | None = None
    told: set[tuple[int, int]] = set()
    for batch in batches:
        links: list[tuple[int, int]] = []
        for *place, role, id_, root, hashes in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if place != at:
                at, ids, roots, held, index, told = place, [], [], [], None, set()
            own = np.frombuffer(hashes, dtype="<u8")
            if role == 0:
                ids.append(id_)
                roots.append(root)
                held.append(own)
                continue
            if not held:
                continue
            if index is None:
                sizes, keys = np.array([len(x) for x in held]), np.concatenate(held)
                order = np.argsort(keys, kind="stable")
                index = keys[order], np.repeat(np.arange(len(held)), sizes)[order], sizes, np.array(roots)
            keys, of, sizes, components_of = index
            low = np.searchsorted(keys, own, "left")
            times = np.searchsorted(keys, own, "right") - low
            where = np.repeat(low - np.cumsum(times) + times, times) + np.arange(times.sum())
            both = np.bincount(of[where], minlength=len(sizes))
            near = (both >= LEAST * (sizes + len(own) - both) - 1e-9) & (components_of != root)
            for i in np.flatnonzero(near).tolist():
                if (i, root) not in told:
                    told.add((i, root))
                    links.append((max(id_, ids[i]), min(id_, ids[i])))
        u, v = zip(*links, strict=True) if links else ((), ())
        yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})


def _labelled(bands: DataFrame, roots: DataFrame) -> DataFrame:
    """``bands`` with the component of each member."""
    return bands.join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", "key", F.coalesce("root", "id").alias("root"))


def _joined(edges: DataFrame, roots: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` with the pairs ``found``, and the components of both; those known so
    far are a star each, and stay as they are where nothing was found."""
    if found.isEmpty():
        return edges, roots
    edges = edges.union(found)
    return edges, components(edges)


def jaccard_roots(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(node, root) for the documents that join a smaller id. ``docs`` (id: bigint, text)
    has each id once; ``kept`` (id, root) has the components known so far."""
    ensure_importable(docs.sparkSession)
    kept = materialize(kept.distinct(), "kept")
    texts = materialize(docs, "kept-texts")
    edges = kept.select(F.col("id").alias("u"), F.col("root").alias("v"))
    roots = kept.select(F.col("id").alias("node"), "root")
    bands = materialize(_bands(texts), "bands")
    for last in (False, True):
        # Buckets with members of one component only have nothing to tell.
        open_keys = _labelled(bands, roots).groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.struct("id", "root")).alias("first")).where("low < high")
        others = _labelled(bands, roots).join(open_keys, "key").where(F.col("root") != F.col("first.root"))
        found = _verified(texts, others.select(F.col("id").alias("u"), F.col("first.id").alias("v")))
        edges, roots = _joined(edges, roots, found)
        members = materialize(_labelled(bands, roots), "bands-labelled")
        discard(bands)
        sizes = members.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"))
        largest = sizes.groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("most"))
        mixed = materialize(largest.where(F.col("n") > F.col("most.n")).select("key", "n", F.col("most.root").alias("most"), (F.col("n") - F.col("most.n")).alias("outside")), "buckets-open")
        if last:
            edges, roots = _joined(edges, roots, _passed(texts, members, mixed))
            break
        outsiders = members.join(mixed.where(F.col("outside") <= NEAR), "key").where("root <> most").select("key", F.col("id").alias("u"), F.col("root").alias("own"))
        pairs = outsiders.join(members, "key").where("root <> own").select(F.greatest("u", "id").alias("u"), F.least("u", "id").alias("v"))
        edges, roots = _joined(edges, roots, _verified(texts, pairs))
        many = mixed.where(F.col("outside") > NEAR)
        if many.isEmpty():
            break
        bands = _prefixes(texts, members.join(many.select("key"), "key", "left_semi").select("id", "key"))
        discard(members)
    for table in (texts, members):
        discard(table)
    return roots
