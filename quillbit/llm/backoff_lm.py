"""Language-model scoring by a weighted backoff automaton (operator 5).

Unigrams, bigrams and trigrams are counted over all training texts, by partial
counts in each task and a sum for each key. The model keeps every n-gram of any
words that occurs ``LEAST`` times, at any size of the corpus, and clearly more often
than the shorter context explains. Discounted n-grams are the arcs of states, one
state for each context; a state's failure arc leads to the next shorter context at
the cost of its backoff weight, so the distribution over the next token sums to one.
At the root stands the add-one unigram over the whole vocabulary.

The model grows with the corpus, so it is a table in the shared folder. Its most
frequent rows are broadcast. For all others, each block of texts asks once for each
of its words and n-grams by a join. From both, the block's part of the automaton is
built, with every state and arc that its texts can reach, and each text is walked
once from left to right. A fixed bitmap spares questions about n-grams that aren't in
the table, and about the words of training texts that occur nowhere else; it can only
let through too many.

Words are known by 64-bit hashes, n-grams by hashes of those. Among the 10^9 rows of a
model, the chance that any two share a key is about 3 %.

Cases: null and empty texts are a single end token; a very long text is a block of
its own; repeated rows are separate texts; with no training text every token is
unknown and the unigram gives it probability one; words of equal count are numbered
together or not at all, and those without a number are joined; counts and sums are of
whole texts. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property, reduce
from itertools import count as numbers

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillbit.llm.common import broadcast_value, discard, materialize, text_slices
from quillbit.session import ARROW_ROWS, ensure_importable, load

#: Rows of the model that are broadcast: words, and n-grams; all others are joined.
#: Every n-gram with LEAST occurrences is a candidate at any size.
WORDS, NGRAMS, LEAST = 1 << 18, 1 << 16, 3
#: A block closes at so many tokens; blocks are scored in so many parts, one after the
#: other, which divides the shuffles that stand on disk at a time.
BLOCK_TOKENS, SLICES = 1 << 18, 4
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bits of a bitmap of keys, as a power of two; a key sets two of them.
BITS = 27
DISCOUNT = 0.5
#: N-grams that a task counts before it hands the counts on.
TASK_GRAMS = 2_000_000
#: Training tokens for each share of the n-grams, which a task adds up at a time.
SHARE_GRAMS = 1 << 19
#: Answers that a task packs by block at a time.
PACK_ROWS = 1 << 19
#: Rows of an Arrow batch of answers, which are four numbers each.
PACK_BATCH = "16384"
FOLDS, FOLD = 7, 2
#: A token that no word equals.
END = b"\n"
SEED = 42
#: Bits of a word number in a packed n-gram; more than WORDS needs.
_SHIFT = 20
BEGIN, END_ID = (xxhash.xxh64_intdigest(w, SEED) for w in (b"\n\n", END))


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % FOLDS == FOLD, F.lit(False))


def token_counts(staged: DataFrame) -> DataFrame:
    """(w, c) over the training texts' blocks, an end for each text; of a beginning,
    the count is zero."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = list(_lines(batch))
            if lines:
                ids, of = np.unique(np.concatenate([x[0] for x in lines]), return_inverse=True)
                n = np.bincount(of, np.concatenate([np.bincount(codes, minlength=len(own)) for own, codes, _ in lines]))
                n[ids == BEGIN] = 0
                yield pa.RecordBatch.from_pydict({"w": _signed(ids), "n": pa.array(n.astype(np.int64))})

    parts = staged.where("not held_out").select("words", "codes").mapInArrow(count, "w bigint, n bigint")
    return parts.groupBy("w").agg(F.sum("n").alias("c")).where("c > 0")


def frequent(counts: DataFrame, most: int) -> tuple[DataFrame, int]:
    """The rows of ``counts`` (.., c) with at least so high a count that no more
    than ``most`` have it, and that count."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 8)
    low, rows = None, 0
    for r in sorted(counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("low")).collect(), key=lambda r: -r.level):
        if rows + r.n > most:
            break
        rows, low = rows + r.n, r.low
    return (counts.where(F.col("c") >= low), low) if low is not None else (counts.limit(0), 1 << 62)


# The automaton


@dataclass
class Arcs:
    """Log10 probability and next state of arcs, which are sorted by key when one is sought."""

    keys: np.ndarray
    chance: np.ndarray
    to: np.ndarray

    @cached_property
    def order(self) -> tuple[np.ndarray, np.ndarray]:
        return _sorted(self.keys, np.arange(len(self.keys)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Numbers of the arcs, -1 where there is none."""
        at, here = _find(keys, self.order[0])
        return np.where(here, self.order[1][at] if len(self.keys) else -1, -1)

    def __contains__(self, key: int) -> bool:
        return bool(self.find(np.array([key]))[0] >= 0)

    def __getitem__(self, key: int) -> tuple[float, int]:
        at = self.find(np.array([key]))[0]
        if at < 0:
            raise KeyError(key)
        return float(self.chance[at]), int(self.to[at])


@dataclass
class Automaton:
    """State 0 is the root. ``arcs`` maps ``word * states + state`` to (log10
    probability, next state); ``fail[s]`` is the next shorter context and ``cost[s]``
    the weight of the way there. ``root[w]`` and ``first[w]`` are the root's arcs, and
    ``base[w]`` the root's chances by themselves.

    A state that has no arc here is left by its failure arc whatever follows, so arcs
    that lead to it pay for that and go on to where it leads. Only what ends a text is
    followed by nothing; the arcs of ``end`` pay nothing more."""

    states: int
    base: np.ndarray
    root: np.ndarray
    first: np.ndarray
    arcs: Arcs
    fail: np.ndarray
    cost: np.ndarray
    #: States up to this number are contexts of one word.
    single: int
    #: For each word of the texts from which this was built, the arc that has it from the
    #: context of one word, and of two; -1 if there is none.
    found: tuple[np.ndarray, np.ndarray] | None = None

    @staticmethod
    def build(root: np.ndarray, weight: np.ndarray, pairs: tuple[np.ndarray, ...], triples: tuple[np.ndarray, ...], end: int | None = None) -> Automaton:
        """``root`` and ``weight``: log10 chance of each word, and its weight as a
        context, NaN if it is none. ``pairs``: the two words, chance and weight of
        each, in the order of a * words + b. ``triples``: the place of the first pair
        in ``pairs``, the last word, the chance. Without ``end`` every arc leads to its
        own state and pays for itself only."""
        n = len(root)
        a, b, chance, own = pairs
        start, last, p = triples
        of_word = np.zeros(n, dtype=np.int64)
        known = np.flatnonzero(~np.isnan(weight))
        of_word[known] = np.arange(1, len(known) + 1)
        of_pair = np.zeros(len(a), dtype=np.int64)
        longer = np.flatnonzero(~np.isnan(own))
        of_pair[longer] = np.arange(len(known) + 1, len(known) + len(longer) + 1)
        fail = np.concatenate(([0], np.zeros(len(known), dtype=np.int64), of_word[b[longer]]))
        cost = np.concatenate(([0.0], weight[known], own[longer]))
        has = np.zeros(len(fail), dtype=bool)
        has[0] = True
        has[of_word[a]] = True
        has[of_pair[start]] = True

        def arc(word: np.ndarray, state: np.ndarray, chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            state, chance = state.copy(), chance.copy()
            for _ in range(0 if end is None else 2):
                idle = ~has[state]
                chance[idle] += np.where(word[idle] == end, 0.0, cost[state[idle]])
                state[idle] = fail[state[idle]]
            return chance, state

        from_root, first = arc(np.arange(n), of_word, root)
        p2, to2 = arc(b, np.where(of_pair > 0, of_pair, of_word[b]), chance)
        states = len(fail)
        at, found = _find(b[start] * n + last, a * n + b)
        p3, to3 = arc(last, np.where(found & (of_pair[at] > 0) if len(of_pair) else found, of_pair[at] if len(of_pair) else at, of_word[last]), p)
        keys = np.concatenate([b * states + of_word[a], last * states + of_pair[start]])
        arcs = Arcs(keys, np.concatenate([p2, p3]), np.concatenate([to2, to3]))
        return Automaton(states, root, from_root, first, arcs, fail, cost, len(known))

    def step(self, state: np.ndarray, word: np.ndarray, arcs: tuple[np.ndarray, np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
        """The chance of each word from the state beside it, and the next state."""
        chance, to, paid = self.root[word], self.first[word], np.zeros(len(word))
        left = np.flatnonzero(state)
        state = state[left]
        while len(left):
            if arcs is None:
                at = self.arcs.find(word[left] * self.states + state)
            else:
                at = np.where(state <= self.single, arcs[0][left], arcs[1][left])
            here = at >= 0
            chance[left[here]], to[left[here]] = self.arcs.chance[at[here]], self.arcs.to[at[here]]
            left, state = left[~here], state[~here]
            paid[left] += self.cost[state]
            state = self.fail[state]
            left, state = left[state > 0], state[state > 0]
        return chance + paid, to

    def walk(self, line: np.ndarray, starts: list[int], begin: int, arcs: tuple[np.ndarray, np.ndarray] | None = None) -> list[float]:
        """log10 probabilities of texts, the words of which stand end to end in
        ``line``, each after ``begin``. A state is a context of at most two words, so
        two steps lead to it from the root, and all words take them together. ``arcs``
        are those of ``found`` if the line is that of all its texts; else they are
        sought."""
        opens = np.zeros(len(line), dtype=bool)
        opens[starts] = True
        before = np.append(0, self.first[line[:-1]])
        before[opens] = self.first[begin]
        after = self.step(before, line, arcs)[1]
        before[1:] = np.where(opens[1:], before[1:], after[:-1])
        # The root's arc of a beginning has no chance of its own.
        opening = self.root[begin] - self.base[begin]
        return (np.add.reduceat(self.step(before, line, arcs)[0], starts) + opening).tolist()


# Keys, and counts of n-grams


def _mix(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Key of an n-gram from its context's key and its last word (uint64)."""
    h = (context ^ (context >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + word
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _signed(keys: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(keys).view(np.int64))


def _unsigned(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.int64, copy=False).view(np.uint64)


def _pack(codes: np.ndarray) -> bytes:
    """Numbers as four compressed planes of bytes."""
    planes = np.ascontiguousarray(codes.astype("<i4").view(np.uint8).reshape(-1, 4).T)
    return len(codes).to_bytes(8, "little") + pa.compress(planes.tobytes(), "zstd", asbytes=True)


def _unpack(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = np.frombuffer(pa.decompress(data[8:], 4 * n, "zstd", asbytes=True), dtype=np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<i4").ravel().astype(np.int64)


def _lines(batch: pa.RecordBatch | pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each block, the sorted ids of its words, and its texts end to end as places
    among them, a beginning before each; and where the beginnings are."""
    for words, codes in zip(batch.column("words"), batch.column("codes"), strict=True):
        ids, line = np.frombuffer(words.as_py(), dtype="<u8"), _unpack(codes.as_py())
        yield ids, line, line == np.searchsorted(ids, np.uint64(BEGIN))


def _within(keys: np.ndarray, bits: np.ndarray) -> np.ndarray:
    out = np.ones(len(keys), dtype=bool)
    for shift in (0, 32):
        at = (keys >> np.uint64(shift)) & np.uint64((1 << BITS) - 1)
        out &= (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1
    return out


def _bitmap(rows: DataFrame) -> np.ndarray:
    """The bitmap of the column ``k``, made by the tasks; 2^BITS bits at any size."""
    at = F.explode(F.array(*[F.shiftrightunsigned("k", shift).bitwiseAND(F.lit((1 << BITS) - 1)) for shift in (0, 32)])).alias("at")
    bit = F.expr("shiftleft(1L, cast(at & 63 as int))")
    slots = rows.select(at).groupBy(F.shiftright("at", 6).cast("int").alias("slot")).agg(F.bit_or(bit).alias("bits"))
    found = _cleaned(rows.sparkSession, slots.toArrow)
    out = np.zeros(1 << (BITS - 6), dtype=np.uint64)
    out[found.column("slot").to_numpy()] = _unsigned(found.column("bits"))
    return out


@dataclass
class Common:
    """The numbered words, most frequent first: ids, counts, and how many texts begin."""

    names: np.ndarray
    counts: np.ndarray
    texts: int
    floor: float

    def __post_init__(self) -> None:
        self.order = np.argsort(self.names)
        self.sorted = self.names[self.order]

    def number(self, ids: np.ndarray) -> np.ndarray:
        """-1 for words without a number, and one more than all others for a beginning."""
        at, here = _find(ids, self.sorted)
        out = np.full(len(ids), -1, dtype=np.int64)
        out[here] = self.order[at[here]]
        out[ids == np.uint64(BEGIN)] = len(self.names)
        return out


def _count(staged: DataFrame, shared, size: int, masks, total: int) -> DataFrame:
    """Bigrams (k, a, b, n, seen, uni) or trigrams (k, a, b, n) of the training texts
    with LEAST occurrences; a and b are the two words, or the keys of the two pairs;
    ``seen`` and ``uni`` are null where only a join knows them. ``masks`` are bitmaps
    of words, arcs and pairs: an n-gram has no more occurrences than its parts, so they
    leave out only what can't count. An n-gram of numbered words is counted as one
    packed number, any other as a key with the top bit set, with the ids of its words.

    Counts go by shares of the n-grams, each in a row of binaries, and are added up in
    arrays. There are as many shares as ``total``, the training tokens, asks for, so a
    share has the same size on any corpus."""
    shares = total // SHARE_GRAMS + 1

    def share_of(g: np.ndarray) -> np.ndarray:
        mixed = _mix(g, np.uint64(size)) >> np.uint64(16)
        return (mixed % np.uint64(shares)).astype(np.uint16 if shares <= 1 << 16 else np.uint32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, (enough, first, second) = shared.value, masks.value
        some = int(np.searchsorted(-common.counts, -LEAST, side="right"))
        packed: list[np.ndarray] = []
        others: list[np.ndarray] = []
        rows = 0

        def out() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(packed), return_counts=True)
            w = np.concatenate(others, axis=1)
            g = _mix(w[0], w[1]) if size == 2 else _mix(_mix(w[0], w[1]), w[2])
            g, index, more = np.unique(g | np.uint64(1 << 63), return_index=True, return_counts=True)
            of = np.concatenate([share_of(keys.view(np.uint64)), share_of(g)])
            # Where the order is stable, the n-grams of a share that have ids come last.
            order = np.argsort(of, kind="stable")
            edges = np.searchsorted(of[order], np.arange(shares + 1))
            g, n, w = np.concatenate([keys.view(np.uint64), g])[order], np.concatenate([n, more]).astype("<u4")[order], w[:, index]
            whole = np.flatnonzero(order >= len(keys))
            ids = np.searchsorted(whole, edges)
            own = order[whole] - len(keys)
            there = np.flatnonzero(edges[1:] > edges[:-1])
            return pa.RecordBatch.from_pydict(
                {
                    "share": pa.array(there, pa.int64()),
                    "g": pa.array([g[edges[i] : edges[i + 1]].tobytes() for i in there], pa.binary()),
                    "n": pa.array([n[edges[i] : edges[i + 1]].tobytes() for i in there], pa.binary()),
                    "w": pa.array([np.ascontiguousarray(w[:, own[ids[i] : ids[i + 1]]].T).tobytes() for i in there], pa.binary()),
                }
            )

        for batch in batches:
            for words, line, begins in _lines(batch):
                own = common.number(words)
                usable = (own < some) & (own >= 0) | (own == len(common.names))
                usable[own < 0] = _within(words[own < 0], enough)
                ids, number, known = words[line], own[line], usable[line]
                ok = known[:-1] & known[1:] & ~begins[1:]
                if size == 3:
                    pair = np.flatnonzero(ok)
                    keys = _mix(ids[pair], ids[pair + 1])
                    left, right = np.zeros(len(ok), dtype=bool), np.zeros(len(ok), dtype=bool)
                    left[pair], right[pair] = _within(keys, first), _within(keys, second)
                    at = np.flatnonzero(left[:-1] & right[1:])
                else:
                    at = np.flatnonzero(ok)
                parts = [number[at + i] for i in range(size)]
                g = np.zeros(len(at), dtype=np.int64)
                for x in parts:
                    g = (g << _SHIFT) | x
                whole = np.min(parts, axis=0) >= 0
                packed.append(g[whole])
                others.append(np.stack([ids[at[~whole] + i] for i in range(size)]))
                rows += len(at)
                if rows > TASK_GRAMS:
                    yield out()
                    packed.clear()
                    others.clear()
                    rows = 0
        if rows:
            yield out()

    def add(rows: pa.Table) -> pa.Table:
        common = shared.value
        listed, seen = np.append(common.names, np.uint64(BEGIN)), np.append(common.counts, common.texts).astype(np.int64)
        whole = lambda c, kind: np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=kind)
        g, n, ids = whole("g", "<u8"), whole("n", "<u4").astype(np.int64), whole("w", "<u8").reshape(-1, size)
        place = np.cumsum(g >> np.uint64(63)).astype(np.int64) - 1  # of those with ids
        order = np.argsort(g, kind="stable")
        g = g[order]
        starts = np.flatnonzero(np.append(True, g[1:] != g[:-1]))
        n = np.add.reduceat(n[order], starts)
        kept = n >= LEAST
        g, n, place = g[starts][kept], n[kept], place[order[starts]][kept]
        numbered = g >> np.uint64(63) == 0
        places = [(g >> np.uint64(_SHIFT * (size - 1 - i))).astype(np.int64) & ((1 << _SHIFT) - 1) for i in range(size)]
        w = []
        for i in range(size):
            x = np.empty(len(g), dtype=np.uint64)
            x[numbered], x[~numbered] = listed[places[i][numbered]], ids[place[~numbered], i]
            w.append(x)
        x = _mix(w[0], w[1])
        keys = (x, w[0], w[1]) if size == 2 else (_mix(x, w[2]), x, _mix(w[1], w[2]))
        out = dict(zip("kab", map(_signed, keys), strict=True)) | {"n": pa.array(n)}
        if size == 2:
            a, b = (seen[np.where(numbered, p, 0)] for p in places)
            out |= {"seen": pa.array(a, mask=~numbered), "uni": pa.array((b + 1) / common.floor, mask=~numbered)}
        return pa.table(out)

    parts = staged.where("not held_out").select("words", "codes").mapInArrow(count, "share bigint, g binary, n binary, w binary")
    return parts.groupBy("share").applyInArrow(add, "k bigint, a bigint, b bigint, n bigint" + (", seen bigint, uni double" if size == 2 else ""))


# The model as a table


def _kept(rows: DataFrame, seen: str, expected: Column) -> DataFrame:
    """``rows`` with the discounted chance ``p`` of an arc; null for n-grams that the
    shorter context explains."""
    enough = F.col("n") >= expected + 3 * F.sqrt(expected) + 1
    return rows.withColumn("p", F.when(enough, (F.col("n") - DISCOUNT) / F.col(seen)))


def _weights(arcs: DataFrame, context: str, shorter: str) -> DataFrame:
    """(context, bw): log10 weight of the failure arcs: the mass that is left, over the
    mass that the shorter context gives to the words without an arc."""
    left = F.greatest(1 - F.sum("p"), F.lit(1e-12)) / F.greatest(1 - F.sum(shorter), F.lit(1e-12))
    return arcs.groupBy(context).agg(F.log10(left).alias("bw"))


def model_table(staged: DataFrame, shared, counts: DataFrame, low_word: int, total: int) -> DataFrame:
    """(k, n, p, bw, gram): a word's or arc's key, count, log10 chance and the weight of
    the state it leads to, if there is one. A beginning has a row as a context."""
    spark, common = staged.sparkSession, shared.value
    floor = common.floor
    unigram = (F.col("c") + 1) / F.lit(floor)
    begin = spark.range(1).select(F.lit(_int64(BEGIN)).alias("w"), F.lit(common.texts).cast("bigint").alias("c"))
    # Only words with LEAST occurrences can be in an n-gram; most have fewer.
    words = _stored(counts.where(F.col("c") >= LEAST).union(begin), "word-ids")
    unnumbered = words.where(F.col("c") < low_word)
    none = np.zeros(0, dtype=np.uint64)
    enough = _bitmap(unnumbered.select(F.col("w").alias("k")))
    bigrams = _stored(_count(staged, shared, 2, broadcast_value(spark, (enough, none, none)), total), "pairs")
    # Words with a number have brought their counts along; only the others are joined.
    rest = bigrams.where("seen is null").drop("seen", "uni")
    rest = rest.join(words.select(F.col("w").alias("a"), F.col("c").alias("seen")), "a").join(words.select(F.col("w").alias("b"), unigram.alias("uni")), "b")
    both = bigrams.where("seen is not null").unionByName(rest)
    tested = _kept(both, "seen", F.col("seen") * F.col("uni")).select("k", "a", "n", "uni", "p")
    first = _stored(_weights(tested.where("p is not null"), "a", "uni"), "word-weights")
    given = F.coalesce("p", F.col("uni") * F.pow(F.lit(10.0), F.coalesce("bw", F.lit(0.0))))
    pairs = _stored(tested.join(first, "a", "left").select("k", "n", "p", given.alias("given")), "pairs-given")
    discard(bigrams)
    arcs = pairs.where("p is not null")
    masks = broadcast_value(spark, (enough, _bitmap(arcs), _bitmap(pairs)))
    triples = _stored(_count(staged, shared, 3, masks, total).select("k", F.col("a").alias("x"), F.col("b").alias("bc"), "n"), "triples")
    found = triples.join(arcs.select(F.col("k").alias("x"), F.col("n").alias("seen")), "x").join(pairs.select(F.col("k").alias("bc"), "given"), "bc")
    longer = _kept(found, "seen", F.col("seen") * F.col("given")).where("p is not null")
    longer = _stored(longer.select("k", "x", "n", "p", "given"), "triples-tested")
    discard(triples)
    second = _weights(longer, "x", "given")
    of_words = words.join(first, words.w == first.a, "left").select(F.col("w").alias("k"), F.col("c").alias("n"), F.log10(unigram).alias("p"), "bw", F.lit(False).alias("gram"))
    rows = of_words.union(counts.where(F.col("c") < LEAST).select("w", "c", F.log10(unigram), F.lit(None).cast("double"), F.lit(False)))
    rows = rows.union(arcs.join(second, arcs.k == second.x, "left").select("k", "n", F.log10("p"), "bw", F.lit(True)))
    rows = rows.union(longer.select("k", "n", F.log10("p"), F.lit(None).cast("double"), F.lit(True)))
    model = _stored(rows, "model")
    for held in (words, first, pairs, longer):
        discard(held)
    return model


def _with(spark, key: str, value: str, run):
    """``run`` under a setting of the session."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        return run()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _cleaned(spark, run):
    """``run``, after which the shuffle files of its queries go. Otherwise they would
    stay until the driver's JVM collects."""
    return _with(spark, _CLEANUP, "true", run)


def _stored(df: DataFrame, label: str) -> DataFrame:
    return _cleaned(df.sparkSession, lambda: materialize(df, label))


def _int64(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


# Scoring


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngrams: int = NGRAMS) -> DataFrame:
    """(id_col, held_out, n_tokens, n_known, train_tokens, base_score, score) for
    every text, the model learnt from those that aren't held out. ``ngrams`` is how
    many n-grams are broadcast; it has no effect on the scores."""
    spark = ensure_importable(docs.sparkSession)
    key, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    rows = docs.select(key.alias("id"), held_out(key).alias("held_out"), text.alias("text"))
    staged = _blocks(rows)
    counts = _stored(token_counts(staged), "token-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    ends = counts.where(F.col("w") == _int64(END_ID)).first()
    chosen, low_word = frequent(counts, WORDS)
    found = chosen.toArrow().sort_by([("c", "descending"), ("w", "ascending")])
    shared = broadcast_value(spark, Common(_unsigned(found.column("w")), found.column("c").to_numpy(), int(ends.c) if ends else 0, float(total + distinct + 1)))
    model = model_table(staged, shared, counts, low_word, int(total))
    discard(counts)
    top_grams, low_gram = frequent(model.where("gram").withColumnRenamed("n", "c"), ngrams)
    top = model.where(~F.col("gram") & (F.col("n") >= low_word)).select("k", "p", "bw").union(top_grams.select("k", "p", "bw")).toArrow()
    held = broadcast_value(spark, _sorted(_unsigned(top.column("k")), top.column("p").to_numpy(), top.column("bw").to_numpy()))
    others = model.where(F.col("n") < F.when(F.col("gram"), low_gram).otherwise(low_word))
    bits = broadcast_value(spark, _bitmap(others.where(F.col("gram") | (F.col("n") > 1))))
    done = []
    for i in range(SLICES):
        part = staged.where(F.pmod("block", F.lit(SLICES)) == i)
        got = _asked(part, held, bits).join(others.select("k", "p", "bw"), "k").select("block", "k", "p", "bw")
        scored = _score(part, shared.value.floor, held, packed(got))
        done.append(_with(spark, ARROW_ROWS, PACK_BATCH, lambda df=scored: _stored(df, "scores")))
    for table in (staged, model):
        discard(table)
    every = reduce(DataFrame.union, done)
    return every.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("bigint").alias("train_tokens"), "base_score", "score")


def _blocks(rows: DataFrame) -> DataFrame:
    """A staged row for each block of texts of one fold: the ids of the texts, those of
    its words, and the texts as places among the words. Every text is cut into words
    once, here."""
    schema = f"block bigint, held_out boolean, id array<{rows.schema['id'].dataType.simpleString()}>, words binary, codes binary"

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = 0
        folds = {False: _Block(), True: _Block()}

        def out(fold: bool) -> pa.RecordBatch:
            nonlocal made
            block, folds[fold] = folds[fold], _Block()
            made += 1
            own = np.array([BEGIN, *(xxhash.xxh64_intdigest(w, SEED) for w in block.words if w is not None)], dtype=np.uint64)
            words, place = np.unique(own, return_inverse=True)
            ids = pa.concat_arrays(block.ids)
            return pa.RecordBatch.from_pydict(
                {
                    "block": pa.array([TaskContext.get().partitionId() << 32 | made], pa.int64()),
                    "held_out": pa.array([fold]),
                    "id": pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids),
                    "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
                    "codes": pa.array([_pack(place[np.concatenate(block.codes)])], pa.binary()),
                }
            )

        for batch in batches:
            for part, texts in text_slices(batch, "text"):
                cut = _Cut(texts)
                of = np.array(part.column("held_out").to_pylist(), dtype=bool)
                for fold in (False, True):
                    mine = np.flatnonzero(of == fold)
                    while len(mine):
                        sizes = np.cumsum(cut.sizes[mine] + 2)
                        n = int(np.searchsorted(sizes, BLOCK_TOKENS - folds[fold].tokens)) + 1
                        folds[fold].add(cut, mine[:n], part.column("id"))
                        mine = mine[n:]
                        if folds[fold].tokens >= BLOCK_TOKENS:
                            yield out(fold)
        for fold in (False, True):
            if folds[fold].ids:
                yield out(fold)

    return _stored(rows.mapInArrow(number, schema), "blocks")


class _Cut:
    """Words ``[^\\x20\\x09-\\x0D]+`` of texts with A-Z in lower case: the distinct ones,
    those of all texts end to end as places among them, and how many each text has."""

    def __init__(self, texts: list[bytes | None]) -> None:
        data = b" ".join([b"", *(t or b"" for t in texts), b""]).lower()
        space = _SPACE[np.frombuffer(data, dtype=np.uint8)]
        edges = (np.flatnonzero(space[1:] != space[:-1]) + 1).astype(np.int64)
        lengths = np.fromiter((len(t or b"") + 1 for t in texts), dtype=np.int64, count=len(texts))
        of = np.searchsorted(np.cumsum(lengths) + 1, edges[::2], side="right")
        self.sizes = np.bincount(of, minlength=len(texts))
        # Words and what stands between them take turns, so edges are offsets of both.
        both = pa.LargeBinaryArray.from_buffers(pa.large_binary(), max(len(edges) - 1, 0), [None, pa.py_buffer(edges), pa.py_buffer(data)])
        found = both.take(pa.array(np.arange(0, len(both), 2))).dictionary_encode()
        self.words, self.codes = found.dictionary, found.indices.to_numpy()
        self.ends = np.cumsum(self.sizes)


_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


class _Block:
    def __init__(self) -> None:
        self.ids: list[pa.Array] = []
        self.words: dict[bytes | None, int] = defaultdict(numbers().__next__)
        self.words[None]  # a beginning is number 0
        self.codes: list[np.ndarray] = []
        self.tokens = 0

    def add(self, cut: _Cut, texts: np.ndarray, ids: pa.Array) -> None:
        """Texts of a cut, by their places, a beginning before and an end after each."""
        sizes = cut.sizes[texts]
        rank = np.repeat(np.arange(len(texts)), sizes)
        place = np.arange(len(rank))
        own = cut.codes[place + (cut.ends[texts] - np.cumsum(sizes))[rank]]
        used = np.zeros(len(cut.words), dtype=bool)
        used[own] = True
        listed = np.flatnonzero(used)
        number = np.zeros(len(used), dtype=np.int32)
        number[listed] = np.fromiter(map(self.words.__getitem__, cut.words.take(pa.array(listed)).to_pylist()), dtype=np.int32, count=len(listed))
        line = np.zeros(len(own) + 2 * len(texts), dtype=np.int32)
        line[np.cumsum(sizes + 2) - 1] = self.words[END]
        line[place + 2 * rank + 1] = number[own]
        self.codes.append(line)
        self.ids.append(ids.take(pa.array(texts)))
        self.tokens += len(line)


def _sorted(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(keys)
    return keys[order], *(v[order] for v in values)


def _find(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the keys stand in the sorted table, and whether they do."""
    if not len(table):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.searchsorted(table, keys).clip(max=len(table) - 1)
    return at, table[at] == keys


def _asked(staged: DataFrame, held, bits) -> DataFrame:
    """(block, k) of what the texts of a block may need of the rows that aren't broadcast."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, mask = held.value[0], bits.value
        for batch in batches:
            for number, fold, (words, line, begins) in zip(batch.column("block").to_pylist(), batch.column("held_out").to_pylist(), _lines(batch), strict=True):
                ids, inner = words[line], np.flatnonzero(~begins)
                pair = _mix(ids[inner - 1], ids[inner])
                longer = np.flatnonzero(~begins[inner - 1])
                grams = np.concatenate([pair, _mix(pair[longer - 1], ids[inner[longer]])])
                # A word of a training text that isn't in the bitmap occurs once.
                asked = words if fold else words[_within(words, mask) | (words == np.uint64(BEGIN))]
                need = np.concatenate([asked, np.unique(grams[_within(grams, mask)])])
                need = need[~_find(need, top)[1]]
                yield pa.RecordBatch.from_pydict({"block": pa.array(np.full(len(need), number)), "k": _signed(need)})

    return staged.select("block", "held_out", "words", "codes").mapInArrow(ask, "block bigint, k bigint")


def packed(rows: DataFrame) -> DataFrame:
    """(block, k, p, bw) with the rows of a block, as many as a task holds at a time,
    in one row of binaries: half the bytes that single rows take in a shuffle, and
    nothing of which to sort. A missing weight is NaN."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0

        def out() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            block = table.column("block").to_numpy()
            order = np.argsort(block)
            block = block[order]
            cuts = np.flatnonzero(block[1:] != block[:-1]) + 1
            cols = {"block": pa.array(block[np.append(0, cuts)])}
            for c in ("k", "p", "bw"):
                values = table.column(c).to_numpy()[order]
                cols[c] = pa.array([x.tobytes() for x in np.split(values, cuts)], pa.binary())
            return pa.RecordBatch.from_pydict(cols)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= PACK_ROWS:
                yield out()
                held.clear()
                n = 0
        if n:
            yield out()

    return rows.select("block", "k", F.col("p"), F.col("bw").cast("double").alias("bw")).mapInArrow(pack, "block bigint, k binary, p binary, bw binary")


def _unpacked(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(rows.column(c).to_pylist()), dtype=kind) for c, kind in (("k", np.uint64), ("p", float), ("bw", float)))


def local_automaton(words: np.ndarray, number: np.ndarray, begins: np.ndarray, look, unknown: float) -> tuple[Automaton, np.ndarray]:
    """The states and arcs that a block's texts can reach, and which of its ``words``
    are known. ``number``: the texts as places among the words. ``look`` gives the
    log10 chance and weight of keys, NaN where there is none."""
    ids = words[number]
    root, weight = look(words)
    inner = np.flatnonzero(~begins)
    keys, of = np.unique(_mix(ids[inner - 1], ids[inner]), return_inverse=True)
    chance, own = look(keys)
    place = np.zeros(len(keys), dtype=np.int64)
    place[of] = inner
    kept = np.flatnonzero(~np.isnan(chance))
    order = np.argsort(number[place[kept] - 1] * len(words) + number[place[kept]])
    kept = kept[order]
    rank = np.full(len(keys), -1)
    rank[kept] = np.arange(len(kept))
    a, b = number[place[kept] - 1], number[place[kept]]
    # Only a pair that is a state has longer arcs.
    after = np.flatnonzero(~begins[inner - 1])
    after = after[(rank[of[after - 1]] >= 0) & ~np.isnan(own[of[after - 1]])]
    grams, index, to = np.unique(_mix(keys[of[after - 1]], ids[inner[after]]), return_index=True, return_inverse=True)
    further = look(grams)[0]
    there = ~np.isnan(further)
    index = after[index[there]]
    triples = (rank[of[index - 1]], number[inner[index]], further[there])
    arc = np.full(len(inner), -1)
    arc[after] = np.where(there, len(kept) + np.cumsum(there) - 1, -1)[to]
    known = ~np.isnan(root)
    model = Automaton.build(np.where(known, root, unknown), weight, (a, b, chance[kept], own[kept]), triples, int(np.searchsorted(words, np.uint64(END_ID))))
    model.found = (rank[of], arc)
    return model, known


def _score(staged: DataFrame, floor: float, held, got: DataFrame) -> DataFrame:
    once, never = float(np.log10(2 / floor)), float(-np.log10(floor))

    def score(texts: pa.Table, rows: pa.Table) -> pa.Table:
        own = _sorted(*_unpacked(rows))

        def look(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p, weight = np.full(len(keys), np.nan), np.full(len(keys), np.nan)
            for table in (held.value, own):
                at, here = _find(keys, table[0])
                p[here], weight[here] = table[1][at[here]], table[2][at[here]]
            return p, weight

        out = []
        for (words, number, begins), fold, names in zip(_lines(texts), texts.column("held_out").to_pylist(), texts.column("id"), strict=True):
            model, known = local_automaton(words, number, begins, look, never if fold else once)
            known |= not fold
            starts = np.flatnonzero(begins)
            text = (np.cumsum(begins) - 1)[~begins]
            line, n = number[~begins], len(starts)
            sums = {"n_tokens": np.bincount(text, minlength=n), "n_known": np.bincount(text, known[line], n).astype(np.int64), "base_score": np.bincount(text, model.base[line], n)}
            sums["score"] = np.array(model.walk(line, (starts - np.arange(n)).tolist(), int(number[0]), model.found))
            out.append(pa.table({"id": names.values, "held_out": pa.array(np.full(n, fold))} | {k: pa.array(v) for k, v in sums.items()}))
        return pa.concat_tables(out)

    id_type = staged.schema["id"].dataType.elementType.simpleString()
    return staged.groupBy("block").cogroup(got.groupBy("block")).applyInArrow(score, f"id {id_type}, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")


def query(spark, sf_dir: str) -> DataFrame:
    return score_texts(load(spark, sf_dir, "documents"))
