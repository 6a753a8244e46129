"""SentencePiece encoding and decoding (operator 1).

Pieces and log scores are read from a public ``.model`` file on the driver and
put into a double-array trie over bytes, which is broadcast (its size is that of
the vocabulary). A text becomes the sequence of pieces with the largest sum of
scores (Unigram Viterbi); a character that no single piece covers costs the
unknown penalty and is written as byte pieces.

No piece crosses from a non-space to a space, and none holds a line feed, so the
best path of a text is the best paths of its segments, cut there. Distinct
segments are decoded together, position by position over a matrix of bytes, and
remembered in a table of bounded size; long ones run through a scalar loop with
the same rules. Sums are float64, so very long texts keep exact scores.

Unused pieces are never produced; user-defined ones are preferred as the format has
it. Of paths of equal score, the one whose last piece is longest is taken, at every
place.

Cases: null gives null ids and null text; an empty text gives no ids; U+2581
counts as a space, as in the format, and so decodes to a space; any other text
decodes to itself, control and NUL characters included; bytes that aren't UTF-8
go through byte pieces one by one. Repeated rows each get their result, and
extra columns are passed through.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillbit.llm.common import broadcast_value, text_slices
from quillbit.session import load

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The format's constants: kinds of pieces, the space marker, and what an unknown
#: character costs below the lowest score.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
MARKER = "▁".encode()
UNKNOWN_PENALTY = 10.0
#: Segments in a worker's table, and the longest segment for the matrix.
MEMORY = 120_000
MATRIX_BYTES = 48


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of a protocol buffer message's fields."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = message[at]
            value |= (byte & 127) << shift
            at, shift = at + 1, shift + 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(message):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = varint(at)
            value, at = message[at : at + size], at + size
        yield tag >> 3, value


class DoubleArray:
    """A trie in two arrays: from state s, byte b leads to t = base[s] + b + 1 if
    check[t] == s. ``value[t]`` is the id of the piece that ends in t, or -1."""

    def __init__(self, keys: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        ids = [-1]
        for key, number in keys.items():
            node = 0
            for b in key:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ids.append(-1)
                node = children[node][b]
            ids[node] = number
        size = 4 * len(children) + 100_000
        base, check, value = (np.full(size, fill, dtype=np.int32) for fill in (0, -1, -1))
        used = np.zeros(size, dtype=bool)
        used[0] = True
        probe, todo = 1, [(0, 0)]
        while todo:
            node, state = todo.pop()
            codes = np.array(sorted(b + 1 for b in children[node]), dtype=np.int64)
            if not len(codes):
                continue
            at, width = max(probe, int(codes[0]) + 1), 256
            while True:
                places = at + np.flatnonzero(~used[at : at + width])
                places = places[~used[(places[:, None] - codes[0] + codes).clip(max=size - 1)].any(axis=1)]
                if len(places):
                    break
                at, width = at + width, 2 * width
                if len(codes) > 1:
                    probe = at  # what lies below is too full
            base[state] = start = int(places[0] - codes[0])
            for b, child in children[node].items():
                t = start + b + 1
                used[t], check[t], value[t] = True, state, ids[child]
                todo.append((child, t))
        last = int(np.flatnonzero(used)[-1]) + 258
        self.base, self.check, self.value = base[:last].copy(), check[:last].copy(), value[:last].copy()


class Pieces:
    """A model file's pieces, ready for encoding and decoding."""

    def __init__(self, model: bytes):
        pieces, self.dummy_prefix = [], True
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))  # type: ignore[arg-type]
                pieces.append((own.get(1, b""), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 3:
                self.dummy_prefix = bool(dict(_fields(value)).get(3, 1))  # type: ignore[arg-type]
        self.scores = np.array([p[1] for p in pieces])
        usable = {p[0]: i for i, p in enumerate(pieces) if p[2] in (NORMAL, USER_DEFINED)}
        # A user-defined piece always wins where it stands: as the format has it, its
        # score is a little below that of as many of the best pieces.
        normal = [p[1] for p in pieces if p[2] == NORMAL]
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == USER_DEFINED:
                self.scores[i] = len(piece.decode()) * max(normal, default=0.0) - 0.1
        spaced = {k.replace(MARKER, b" "): i for k, i in usable.items()}
        if any(b"\n" in k or re.search(rb"[^ ] ", k) for k in spaced):
            raise ValueError("pieces cross the borders of segments")
        self.trie = DoubleArray(spaced)
        self.longest = max(map(len, spaced), default=1)
        self.unknown_score = min(normal, default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = next((i for i, p in enumerate(pieces) if p[2] == UNKNOWN), 0)
        self.byte_ids = np.full(256, self.unknown_id, dtype=np.int32)
        self.surface: list[bytes] = []
        for i, (piece, _, kind) in enumerate(pieces):
            if kind == BYTE:
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            else:
                self.surface.append(b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else piece.replace(MARKER, b" "))
        self.memory: dict[bytes, bytes] = {}

    def __getstate__(self):
        return self.__dict__ | {"memory": {}}

    # Encoding

    _SEGMENT = re.compile(rb"\n| *[^ \n]+| +")

    def segments(self, text: bytes) -> list[bytes]:
        if not text:
            return []
        if MARKER in text:
            text = text.replace(MARKER, b" ")
        return self._SEGMENT.findall(b" " + text if self.dummy_prefix else text)

    def encode_all(self, texts: list[bytes | None]) -> list[bytes | None]:
        """The ids of each text as packed little-endian int32."""
        split = [None if t is None else self.segments(t) for t in texts]
        missing = list({s for x in split if x for s in x if s not in self.memory})
        if len(self.memory) + len(missing) > MEMORY:
            self.memory = {s: self.memory[s] for x in split if x for s in x if s in self.memory}
        for i in range(0, len(missing), 4_000):
            self.memory.update(self._solve(missing[i : i + 4_000]))
        get = self.memory.__getitem__
        return [None if x is None else b"".join(map(get, x)) for x in split]

    def encode(self, text: str) -> list[int]:
        packed = self.encode_all([text.encode()])[0]
        return np.frombuffer(packed, dtype="<i4").tolist()

    def _solve(self, segments: list[bytes]) -> dict[bytes, bytes]:
        out = {}
        groups: dict[int, list[bytes]] = {}
        for s in segments:
            if len(s) > MATRIX_BYTES:
                out[s] = self.best_path(s)
            else:
                groups.setdefault(-(-len(s) // 8), []).append(s)
        for group in groups.values():
            out.update(self._best_paths(group))
        return out

    def _best_paths(self, segments: list[bytes]) -> dict[bytes, bytes]:
        """Viterbi over all segments at once, one byte position at a time."""
        n, width = len(segments), max(map(len, segments))
        lengths = np.fromiter(map(len, segments), dtype=np.int64, count=n)
        codes = np.frombuffer(b"".join(s.ljust(width, b"\0") for s in segments), dtype=np.uint8).reshape(n, width).astype(np.int64)
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        came = np.zeros((n, width + 1), dtype=np.int64)
        piece = np.full((n, width + 1), -1, dtype=np.int64)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for i in range(width):
            here = np.flatnonzero((best[:, i] > -np.inf) & (lengths > i))
            if not len(here):
                continue
            step = char_lengths(codes, here, i, lengths)
            single = np.zeros(len(here), dtype=bool)
            rows, state, own = here, np.zeros(len(here), dtype=np.int64), np.arange(len(here))
            for j in range(i, min(width, i + self.longest)):
                inside = lengths[rows] > j
                rows, state, own = rows[inside], state[inside], own[inside]
                to = base[state] + codes[rows, j] + 1
                ok = check[to] == state
                rows, state, own = rows[ok], to[ok].astype(np.int64), own[ok]
                if not len(rows):
                    break
                ids = value[state]
                end = ids >= 0
                r, ids, o = rows[end], ids[end], own[end]
                single[o[step[o] == j + 1 - i]] = True
                total = best[r, i] + self.scores[ids]
                better = total > best[r, j + 1]
                r, ids, total = r[better], ids[better], total[better]
                best[r, j + 1], came[r, j + 1], piece[r, j + 1] = total, i, ids
            r, end = here[~single], i + step[~single]
            total = best[r, i] + self.unknown_score
            better = total > best[r, end]
            r, end = r[better], end[better]
            best[r, end], came[r, end], piece[r, end] = total[better], i, -1
        out = {}
        for s, back, ids in zip(segments, came.tolist(), piece.tolist(), strict=True):
            out[s] = self._packed(s, back, ids)
        return out

    def best_path(self, s: bytes) -> bytes:
        """The same for one segment, by a scalar loop."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        best, came, piece = [-np.inf] * (len(s) + 1), [0] * (len(s) + 1), [-1] * (len(s) + 1)
        best[0] = 0.0
        for i in range(len(s)):
            if best[i] == -np.inf:
                continue
            step, state, single = char_length(s, i), 0, False
            for j in range(i, len(s)):
                to = int(base[state]) + s[j] + 1
                if check[to] != state:
                    break
                state, found = to, int(value[to])
                if found >= 0:
                    single |= j + 1 - i == step
                    total = best[i] + float(self.scores[found])
                    if total > best[j + 1]:
                        best[j + 1], came[j + 1], piece[j + 1] = total, i, found
            total = best[i] + self.unknown_score
            if not single and total > best[i + step]:
                best[i + step], came[i + step], piece[i + step] = total, i, -1
        return self._packed(s, came, piece)

    def _packed(self, s: bytes, came: list[int], piece: list[int]) -> bytes:
        end, out = len(s), []
        while end > 0:
            start, found = came[end], piece[end]
            if found >= 0:
                out.append(found)
            else:
                out += [int(self.byte_ids[b]) for b in reversed(s[start:end])]
            end = start
        return struct.pack(f"<{len(out)}i", *reversed(out))

    # Decoding

    def decode_bytes(self, packed: bytes) -> bytes:
        """Bytes of the text: markers become spaces, byte pieces their byte, and
        the space that encoding put in front goes."""
        out = b"".join(map(self.surface.__getitem__, np.frombuffer(packed, dtype="<i4").tolist()))
        return out[1:] if self.dummy_prefix and out[:1] == b" " else out

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(struct.pack(f"<{len(ids)}i", *ids)).decode("utf-8", "replace")


def char_length(s: bytes, at: int) -> int:
    """Bytes of the character at ``at``, cut at the end; 1 for a stray byte."""
    b = s[at]
    return min(1 if b < 0xC0 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4, len(s) - at)


def char_lengths(codes: np.ndarray, rows: np.ndarray, at: int, lengths: np.ndarray) -> np.ndarray:
    b = codes[rows, at]
    return np.minimum(1 + (b >= 0xC0).astype(np.int64) + (b >= 0xE0) + (b >= 0xF0), lengths[rows] - at)


def load_pieces(path: str = MODEL) -> Pieces:
    with open(path, "rb") as f:
        return Pieces(f.read())


_HELD: dict[int, Pieces] = {}


def _held(shared) -> Pieces:
    """One object for each worker process, whose table lasts over tasks."""
    if shared.value is not _HELD.get(0):
        _HELD[0] = shared.value
    return _HELD[0]


def encode_texts(docs: DataFrame, text_col: str = "text", model: str = MODEL, ids_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` with an ``array<int>`` column of piece ids, and with the decoded
    text if ``decoded_col`` is named. A column of the same name is replaced."""
    shared = broadcast_value(docs.sparkSession, load_pieces(model))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _held(shared)
        for batch in batches:
            for rows, texts in text_slices(batch, text_col, "row"):
                ids = pieces.encode_all(texts)
                ends = np.cumsum([0, *[len(x or b"") // 4 for x in ids]])
                flat = pa.array(np.frombuffer(b"".join(x or b"" for x in ids), dtype=np.int32))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat, mask=pa.array([x is None for x in ids]))
                cols = {"row": rows.column("row"), "ids": lists}
                if decoded_col:
                    cols["decoded"] = pa.array([None if x is None else pieces.decode_bytes(x).decode("utf-8", "replace") for x in ids], pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    schema = f"row {packed.schema['row'].dataType.simpleString()}, ids array<int>" + (", decoded string" if decoded_col else "")
    added = {ids_col: "ids"} | ({decoded_col: "decoded"} if decoded_col else {})
    return packed.mapInArrow(encode, schema).select(*[F.col(f"row.`{c}`") for c in docs.columns if c not in added], *[F.col(v).alias(k) for k, v in added.items()])


def decode_ids(rows: DataFrame, ids_col: str = "token_ids", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """``rows`` with the text of the ids in ``ids_col``; null ids give null."""
    shared = broadcast_value(rows.sparkSession, load_pieces(model))

    @F.pandas_udf("string")
    def decode(ids):
        pieces = _held(shared)
        return ids.map(lambda x: None if x is None else pieces.decode_bytes(np.asarray(x, dtype="<i4").tobytes()).decode("utf-8", "replace"))

    return rows.withColumn(text_col, decode(F.col(ids_col)))


def summarize(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(id, n_bytes, n_tokens, n_byte_tokens, ids_sha256, round_trip) of every
    text: the digest is over the ids as little-endian int32; ``round_trip`` says
    whether decoding gave the text back. The ids don't leave the worker."""
    shared = broadcast_value(docs.sparkSession, load_pieces(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _held(shared)
        is_byte = np.zeros(len(pieces.surface), dtype=bool)
        is_byte[pieces.byte_ids] = True
        for batch in batches:
            for rows, texts in text_slices(batch, "text"):
                ids = pieces.encode_all(texts)
                flat = is_byte[np.frombuffer(b"".join(x or b"" for x in ids), dtype=np.int32)]
                counts = np.concatenate(([0], np.cumsum(flat)))
                ends = np.cumsum([0, *[len(x or b"") // 4 for x in ids]])
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": rows.column("id"),
                        "n_bytes": pa.array([None if t is None else len(t) for t in texts], pa.int64()),
                        "n_tokens": pa.array([None if x is None else len(x) // 4 for x in ids], pa.int64()),
                        "n_byte_tokens": pa.array([None if x is None else int(n) for x, n in zip(ids, np.diff(counts[ends]), strict=True)], pa.int64()),
                        "ids_sha256": pa.array([None if x is None else hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        "round_trip": pa.array([None if x is None else pieces.decode_bytes(x) == t.replace(MARKER, b" ") for x, t in zip(ids, texts, strict=True)], pa.bool_()),
                    }
                )

    id_type = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, f"id {id_type}, n_bytes bigint, n_tokens bigint, n_byte_tokens bigint, ids_sha256 string, round_trip boolean").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return summarize(load(spark, sf_dir, "documents"))
