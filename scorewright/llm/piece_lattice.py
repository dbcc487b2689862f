"""SentencePiece encoding and decoding as relations.

Text is cut in words at places that no piece spans. The distinct words of a few MB of documents are exploded into
bounded-length substrings, which meet the piece table by an equi-join on their hashes; the edges are grouped by word, and
a higher-order aggregate of Spark folds each word's lattice to its boundaries. A unigram model folds by Viterbi. A BPE model's
ids are not the best path by scores, so its lattice is folded by its merges: edges in the order of their scores, each of
which joins two neighbours that stand where it needs them.

Explode, join and grouping run column by column on Arrow batches, where a row for each substring, some sixty a word, never
exists. Nothing is shuffled or written: words meet inside a task, and the piece table is of the model's size.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table

SPACE = "▁"
#: Boundaries are the bits of a long. A longer word without a place that no piece spans is folded outside the lattice, with equal ids.
MAX_WORD = 62
#: Bytes of text whose words are made distinct together, and words that one row carries.
CHUNK, ROW = 4_000_000, 4096
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
U = np.uint64
TURN, SPREAD = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93)


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        size = {0: 0, 1: 8, 5: 4}.get(key & 7)
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if size is None else size
        yield key >> 3, data[at : at + size]
        at += size


@dataclass(frozen=True)
class Model:
    pieces: tuple[tuple[str, float, int], ...]
    bpe: bool

    @staticmethod
    def read(path: str) -> Model:
        """The model file; only those that leave text as it is (identity, dummy prefix, spaces kept) are taken."""
        pieces, kind = [], 1
        with open(path, "rb") as f:
            for number, value in fields(f.read()):
                own = dict(fields(value)) if number in (1, 2, 3) else {}
                if number == 1:
                    pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
                elif number == 2:
                    kind = own.get(3, 1)
                elif number == 3 and (own.get(2) or own.get(4, 1) or not own.get(3, 1)):
                    raise ValueError("a model that rewrites its text")
        if kind not in (1, 2):
            raise ValueError("neither a unigram nor a BPE model")
        return Model(tuple(pieces), kind == 2)

    @cached_property
    def table(self) -> dict[str, tuple[int, float]]:
        """Pieces by their text, with a plain space for the mark."""
        return {p.replace(SPACE, " "): (i, s) for i, (p, s, t) in enumerate(self.pieces) if t in (NORMAL, USER)}

    @property
    def bytes_from(self) -> int:
        return next(i for i, p in enumerate(self.pieces) if p[2] == BYTE)

    @property
    def unknown(self) -> float:
        return min(s for _, s in self.table.values()) - 10.0

    def alone(self) -> set[str]:
        """Pieces of a BPE model whose own text its merges, tried once each from the best on, don't make whole."""
        table, out = self.table, set()
        for p in (p for p in table if len(p) > 1):
            edges = sorted((-table[p[i:j]][1], i, j) for i in range(len(p)) for j in range(i + 2, len(p) + 1) if p[i:j] in table)
            bounds = list(range(len(p) + 1))
            for _, i, j in edges:
                if i in bounds and bounds.index(i) + 2 < len(bounds) and bounds[bounds.index(i) + 2] == j:
                    del bounds[bounds.index(i) + 1]
            if len(bounds) > 2:
                out.add(p)
        return out


def hashed(p: np.ndarray) -> np.uint64:
    h = U(0)
    for c in p:
        h = h * TURN + (U(c) + U(1)) * SPREAD
    return h


class Pieces:
    """The piece table as columns, sorted by the hash of the text, and what the cut into words needs."""

    def __init__(self, model: Model):
        self.model, table = model, model.table
        points = {p: np.array([ord(c) for c in p], U) for p in table}
        with np.errstate(over="ignore"):
            key = {p: hashed(x) for p, x in points.items()}
        order = sorted(table, key=lambda p: int(key[p]))
        self.key = np.array([key[p] for p in order], U)
        if len(np.unique(self.key)) < len(self.key):
            raise ValueError("two pieces of one hash")
        self.id = np.array([table[p][0] for p in order], np.int64)
        self.score = np.array([table[p][1] for p in order])
        self.rank = np.unique(-self.score, return_inverse=True)[1].astype(U)  # equal scores, equal ranks
        odd = model.alone() if model.bpe else set()
        self.odd = np.array([p in odd for p in order])
        self.longest = max(map(len, table))
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.slot(self.key)] = True
        joined = {c for p in table if len(p) > 1 for c in p}
        self.lone = np.array([b < 128 and chr(b) not in joined for b in range(256)])  # these bytes are words of their own
        self.inner = any(" " in p.lstrip(" ") for p in table)
        self.pairs = np.unique(np.concatenate([np.zeros(0, U), *(x[:-1] << U(21) | x[1:] for x in points.values() if len(x) > 1)]))

    @staticmethod
    def slot(h: np.ndarray) -> np.ndarray:
        return (h ^ (h >> U(32))) * TURN >> U(44)

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of h that are pieces, their rows in the table)."""
        hit = np.flatnonzero(self.maybe[self.slot(h)])
        row = np.minimum(np.searchsorted(self.key, h[hit]), len(self.key) - 1)
        ok = self.key[row] == h[hit]
        return hit[ok], row[ok]


def bounds(raw: np.ndarray, ends: np.ndarray, p: Pieces) -> np.ndarray:
    """Where the words of documents that stand side by side end: before a space that follows another character, around bytes
    in no longer piece, and at the documents' ends."""
    if not len(raw):
        return np.zeros(0, np.int64)
    space, lone = raw == 32, p.lone[raw]
    cut = np.zeros(len(raw) + 1, bool)
    cut[:-1] |= lone
    cut[1:] |= lone
    if not p.inner:
        cut[1:-1] |= space[1:] & ~space[:-1]
    cut[ends] = True
    cut[0] = False
    at = np.flatnonzero(cut)
    long = np.flatnonzero(np.diff(at, prepend=0) > MAX_WORD)
    more = [np.zeros(0, np.int64)]
    for k in long.tolist():  # cut long words between characters that stand side by side in no piece
        a = int(at[k - 1]) if k else 0
        points = np.frombuffer(raw[a : at[k]].tobytes().decode().encode("utf-32-le"), np.uint32).astype(U)
        pair = points[:-1] << U(21) | points[1:]
        place = np.minimum(np.searchsorted(p.pairs, pair), max(len(p.pairs) - 1, 0))
        free = np.flatnonzero(p.pairs[place] != pair) if len(p.pairs) else np.arange(len(pair))
        first = np.flatnonzero((raw[a : at[k]] & 0xC0) != 0x80)
        more.append(a + first[free + 1])
    return np.unique(np.concatenate([at, *more]))


def points_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all words, how many each has)."""
    data, offsets = spans_of(words)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(U), np.diff(starts[offsets])


def spans_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary array."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def edges_of(points: np.ndarray, n: np.ndarray, p: Pieces) -> np.ndarray:
    """The lattices of words, sorted by word: words' number, rank, start and length, each edge packed in 64 bits, then its row.

    Substrings of one length are made from those of one less, met with the table, and kept where they are pieces.
    """
    word = np.repeat(np.arange(len(n)), n)
    begin = np.cumsum(n) - n
    left = np.repeat(begin + n, n) - np.arange(len(points))
    spot, h = np.arange(len(points)), np.zeros(len(points), U)
    packed, rows = [np.zeros(0, U)], [np.zeros(0, np.int64)]
    for length in range(1, p.longest + 1):
        live = left[spot] >= length
        spot = spot[live]
        h = h[live] * TURN + (points[spot + length - 1] + U(1)) * SPREAD
        if not len(spot):
            break
        if length == 1 and p.model.bpe:
            continue
        at, row = p.find(h)
        w = word[spot[at]]
        packed.append((w.astype(U) << U(34)) | (p.rank[row] << U(12)) | ((spot[at] - begin[w]).astype(U) << U(6)) | U(length))
        rows.append(row)
    return np.concatenate(packed), np.concatenate(rows)


def lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def word_rows(words: pa.Array, p: Pieces) -> Iterator[dict[str, pa.Array]]:
    """Rows of ROW words with their lattices."""
    one = U(1)
    for at in range(0, len(words), ROW):
        part = words.slice(at, ROW)
        points, n = points_of(part)
        short = n <= MAX_WORD
        keep = np.repeat(short, n)
        packed, row = edges_of(points[keep], np.where(short, n, 0), p)
        order = np.argsort(packed)
        packed, row = packed[order], row[order]
        w = (packed >> U(34)).astype(np.int64)
        start = (packed >> U(6)) & U(63)
        end = start + (packed & U(63))
        if p.model.bpe:
            ends = (one << start) | (one << end)
            edge = pa.StructArray.from_arrays([pa.array(ends.view(np.int64)), pa.array(((one << end) - (one << (start + one))).view(np.int64))], ["ends", "inside"])
        else:
            edge = pa.StructArray.from_arrays([pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32)), pa.array(p.score[row])], ["start", "end", "score"])
        odd = np.zeros(len(n), bool)
        odd[w[p.odd[row]]] = True
        whole = len(n)
        yield {
            "data": pa.array([spans_of(part)[0].tobytes()], pa.binary()),
            "n": lists([whole], pa.array(n, pa.int32())),
            "odd": lists([whole], pa.array(odd)),
            "edges": lists([whole], lists(np.bincount(w, minlength=whole), edge)),
        }


def lattices(docs: DataFrame, model: Model) -> DataFrame:
    """docs(id, text) -> rows of words with their lattices, and after the words of each CHUNK a row of the documents that are
    made of them: their ids, how many words each has, and the words' numbers. The order of rows in a partition matters."""
    kind = dict(docs.dtypes)["id"]
    edge = "struct<ends:long,inside:long>" if model.bpe else "struct<start:int,end:int,score:double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, held, size = Pieces(model), [], 0
        own: pa.DataType | None = None

        def row(**cols: pa.Array) -> pa.RecordBatch:
            empty = {"data": pa.binary(), "n": pa.list_(pa.int32()), "odd": pa.list_(pa.bool_()), "edges": None, "docs": pa.list_(own), "counts": pa.list_(pa.int32()), "codes": pa.list_(pa.int32())}
            pair = pa.struct([("ends", pa.int64()), ("inside", pa.int64())]) if model.bpe else pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])
            empty["edges"] = pa.list_(pa.list_(pair))
            return pa.RecordBatch.from_arrays([cols[c] if c in cols else pa.nulls(1, t) for c, t in empty.items()], names=list(empty))

        def flush() -> Iterator[pa.RecordBatch]:
            texts = [b" " + t.replace(SPACE.encode(), b" ") if t else b"" for _, t in held]
            ends = np.cumsum(np.array(list(map(len, texts)), np.int64))
            raw = np.frombuffer(b"".join(texts), np.uint8)
            at = bounds(raw, ends, p)
            offsets = pa.py_buffer(np.concatenate([[0], at]).astype(np.int32))
            words = pa.Array.from_buffers(pa.binary(), len(at), [None, offsets, pa.py_buffer(raw)]).dictionary_encode()
            for cols in word_rows(words.dictionary, p):
                yield row(**cols)
            counts = np.diff(np.searchsorted(at, ends, side="right"), prepend=0)
            yield row(docs=lists([len(held)], pa.array([i for i, _ in held], own)), counts=lists([len(held)], pa.array(counts, pa.int32())), codes=lists([len(at)], words.indices))

        with np.errstate(over="ignore"):
            for batch in batches:
                own = batch.schema.field(0).type
                for k in range(0, batch.num_rows, 256):
                    part = batch.slice(k, 256)
                    for i, t in zip(part.column(0).to_pylist(), part.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                        if held and size + len(t or b"") > CHUNK:
                            yield from flush()
                            held, size = [], 0
                        held.append((i, t))
                        size += len(t or b"")
            if held:
                yield from flush()

    return docs.mapInArrow(run, f"data binary, n array<int>, odd array<boolean>, edges array<array<{edge}>>, docs array<{kind}>, counts array<int>, codes array<int>")


def bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def merges(b: Column, e: Column) -> Column:
    """Whether the edge's ends are boundaries with one boundary between them."""
    return (b.bitwiseAND(e["ends"]) == e["ends"]) & (F.bit_count(b.bitwiseAND(e["inside"])) == 1)


def merged_once(edges: Column, n: Column) -> Column:
    """Boundaries after all merges, as bits of a long; edges in the order of merges.

    Each edge is tried once. While both its ends are boundaries, all merges inside it were those of its text alone, which
    leave it two parts at its turn unless its piece is one of Model.alone.
    """
    return F.aggregate(edges, bit(n + 1) - 1, lambda b, e: F.when(merges(b, e), b - b.bitwiseAND(e["inside"])).otherwise(b))


def merged(edges: Column, n: Column) -> Column:
    """The same by as many searches for the best edge as there may be merges; right for every vocabulary."""

    def step(b: Column, _: Column) -> Column:
        best = F.get(F.filter(edges, lambda e: merges(b, e)), F.lit(0))
        return F.when(best.isNull(), b).otherwise(b - b.bitwiseAND(best["inside"]))

    return F.aggregate(F.sequence(F.lit(1), n), bit(n + 1) - 1, step)


def viterbi(edges: Column, n: Column, unknown: float) -> Column:
    """Boundaries of the path with the best sum of scores, as bits; a character without an edge costs unknown."""
    start = F.array(F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("back")))

    def step(a: Column, i: Column) -> Column:
        into = F.filter(edges, lambda e: e["end"] == i)
        ways = F.transform(into, lambda e: F.struct((F.get(a, e["start"])["score"] + e["score"]).alias("score"), e["start"].alias("back")))
        lone = F.struct((F.get(a, i - 1)["score"] + F.lit(unknown)).alias("score"), (i - 1).alias("back"))
        return F.concat(a, F.array(F.array_max(F.concat(ways, F.when(F.exists(into, lambda e: e["start"] == i - 1), F.array().cast("array<struct<score:double,back:int>>")).otherwise(F.array(lone))))))

    def walk(best: Column) -> Column:
        both = lambda at, b: F.struct(at.alias("at"), b.alias("b"))

        def back(s: Column, _: Column) -> Column:
            to = F.get(best, s["at"])["back"]
            return F.when(s["at"] == 0, s).otherwise(both(to, s["b"].bitwiseOR(bit(to))))

        return F.aggregate(F.sequence(F.lit(1), n), both(n, bit(n)), back, lambda s: s["b"])

    return let(F.aggregate(F.sequence(F.lit(1), n), start, step), walk)


def folded(rows: DataFrame, model: Model) -> DataFrame:
    """The lattices' rows with bits, the boundaries of each word, for its edges; a word beyond MAX_WORD has none."""

    def one(e: Column, i: Column) -> Column:
        n = F.get(F.col("n"), i)
        best = F.when(F.get(F.col("odd"), i), merged(e, n)).otherwise(merged_once(e, n)) if model.bpe else viterbi(e, n, model.unknown)
        return F.when(n <= MAX_WORD, best)

    return rows.select("data", "n", F.transform("edges", one).alias("bits"), "docs", "counts", "codes")


def outside(text: str, p: Pieces) -> list[int]:
    """Ids of a word beyond MAX_WORD: merges in a heap, or the best path, position by position."""
    table, first = p.model.table, p.model.bytes_from
    if p.model.bpe:
        part, nxt, prev = list(text), [*range(1, len(text)), -1], [-1, *range(len(text) - 1)]
        heap: list[tuple[float, int, str]] = []

        def push(i: int) -> None:
            j = nxt[i] if i >= 0 else -1
            if j >= 0 and (both := part[i] + part[j]) in table:
                heapq.heappush(heap, (-table[both][1], i, both))

        for i in range(len(text)):
            push(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = nxt[i]
            if j < 0 or not part[i] or part[i] + part[j] != both:
                continue
            part[i], part[j], nxt[i] = both, "", nxt[j]
            if nxt[j] >= 0:
                prev[nxt[j]] = i
            push(prev[i])
            push(i)
        parts = [x for x in part if x]
    else:
        best: list[tuple[float, int]] = [(0.0, 0)]
        for i in range(1, len(text) + 1):
            ways = [(best[s][0] + table[text[s:i]][1], s) for s in range(max(0, i - p.longest), i) if text[s:i] in table]
            if text[i - 1 : i] not in table:
                ways.append((best[i - 1][0] + p.model.unknown, i - 1))
            best.append(max(ways))
        parts, i = [], len(text)
        while i:
            parts.append(text[best[i][1] : i])
            i = best[i][1]
        parts.reverse()
    return [x for q in parts for x in ([table[q][0]] if q in table else [first + b for b in q.encode()])]


def word_ids(data: np.ndarray, n: np.ndarray, bits: np.ndarray, known: np.ndarray, p: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words, how many each has) from the boundaries of each; known marks the words that have them."""
    text = data.tobytes().decode()
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(U)
    begin = np.cumsum(n) - n
    word = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(points)) - begin[word]
    head = np.flatnonzero(~known[word] | (((bits.view(U)[word] >> np.minimum(place, 63).astype(U)) & U(1)) > 0))
    length = np.diff(np.append(head, len(points)))
    h = np.zeros(len(head), U)
    for k in range(min(int(length.max(initial=0)), p.longest)):
        live = length > k
        h[live] = h[live] * TURN + (points[head[live] + k] + U(1)) * SPREAD
    hit, row = p.find(h)
    hit, row = hit[length[hit] <= p.longest], row[length[hit] <= p.longest]
    own = word[head]
    many = 1 + sum((points[head] >= c).astype(np.int64) for c in (0x80, 0x800, 0x10000))  # bytes, where a character is no piece
    many[hit] = 1
    many[~known[own]] = 0
    out = np.zeros(int(many.sum()), np.int64)
    at = np.cumsum(many) - many
    got = known[own[hit]]
    out[at[hit[got]]] = p.id[row[got]]
    bare = np.ones(len(head), bool)
    bare[hit] = False
    counts = np.bincount(own, many, len(n)).astype(np.int64)
    for k in np.flatnonzero(bare & known[own]).tolist():
        b = text[head[k]].encode()
        out[at[k] : at[k] + len(b)] = p.model.bytes_from + np.frombuffer(b, np.uint8)
    if known.all():
        return out, counts
    ends, parts = np.cumsum(counts), []
    for k in np.flatnonzero(~known).tolist():
        ids = outside(text[begin[k] : begin[k] + n[k]], p)
        counts[k] = len(ids)
        parts.append((int(ends[k]), ids))
    return np.insert(out, [a for a, ids in parts for _ in ids], [i for _, ids in parts for i in ids]), counts


def encode(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """One row for each of docs: id and ids, an array in order, and, with decoded, decoded: the text that the ids give back.

    Null and empty texts have none; repeated rows get equal ids; null ids are values; other columns are ignored. An
    empty table gives an empty table.
    """
    at = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(at.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, back, ids, counts = Pieces(model), Texts(model), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        flat = lambda c, k: c.slice(k, 1).flatten().to_numpy(zero_copy_only=False)
        with np.errstate(over="ignore"):
            for batch in batches:
                data, n, bits, owners, sizes, codes = batch.columns
                for k in range(batch.num_rows):
                    if data[k].is_valid:
                        known = bits.slice(k, 1).flatten()
                        mine, many = word_ids(np.frombuffer(data[k].as_buffer(), np.uint8), flat(n, k).astype(np.int64), known.fill_null(0).to_numpy(), np.asarray(known.is_valid()), p)
                        ids.append(mine)
                        counts.append(many)
                        continue
                    all_ids, each = np.concatenate(ids), np.concatenate(counts)
                    begin, code, words = np.cumsum(each) - each, flat(codes, k), flat(sizes, k)
                    many = each[code]
                    end = np.cumsum(many)
                    pick = np.arange(int(many.sum())) + np.repeat(begin[code] - (end - many), many)
                    upto = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(words)])]
                    cols = [owners.slice(k, 1).flatten(), lists(np.diff(upto), pa.array(all_ids[pick], pa.int32()))]
                    yield pa.RecordBatch.from_arrays(cols + [back.of(cols[1])] * decoded, names=["id", "ids", "decoded"][: 2 + decoded])
                    ids, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

    return folded(lattices(at, model), model).mapInArrow(run, f"id {kind}, ids array<int>" + ", decoded string" * decoded).withColumnRenamed("id", id_col)


class Texts:
    """The texts of ids: pieces side by side, gathered byte by byte."""

    def __init__(self, model: Model):
        first = model.bytes_from
        code = [p.replace(SPACE, " ").encode() if t in (NORMAL, USER) else bytes([i - first]) if t == BYTE else " ⁇ ".encode() if t == UNKNOWN else b"" for i, (p, _, t) in enumerate(model.pieces)]
        self.size = np.array(list(map(len, code)))
        self.data, self.start = np.frombuffer(b"".join(code), np.uint8), np.cumsum(self.size) - self.size

    def of(self, rows: pa.ListArray) -> pa.Array:
        out: list[str | None] = []
        for k in range(0, len(rows), 256):
            part = rows.slice(k, 256)
            ids = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
                raise ValueError("an id that the model does not have")
            n = np.array([0 if x is None else x for x in pa.compute.list_value_length(part).to_pylist()], np.int64)
            many = self.size[ids]
            upto = np.concatenate([[0], np.cumsum(many)])
            raw = self.data[np.arange(int(upto[-1])) + np.repeat(self.start[ids] - upto[:-1], many)].tobytes()
            ends = upto[np.concatenate([[0], np.cumsum(n)])]
            out += [raw[a:b].decode(errors="replace").removeprefix(" ") if ok else None for a, b, ok in zip(ends[:-1], ends[1:], part.is_valid().to_pylist(), strict=True)]
        return pa.array(out, pa.string())


def decode(encoded: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """id and text of rows of id and ids, one row each: pieces joined, marks as spaces but for the one put in front, byte
    pieces as UTF-8. Null ids give null, none an empty text; an id outside the table is an error."""
    at = encoded.select(F.col(id_col).alias("id"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = Texts(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), back.of(batch.column(1))], names=["id", "text"])

    return at.mapInArrow(run, f"id {dict(at.dtypes)['id']}, text string").withColumnRenamed("id", id_col)


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids, comma-joined), and decoded_sha256, of the text that the ids give back."""
    coded = encode(read_table(spark, sf_dir, "documents").select("doc_id", "text"), Model.read(model_path()), decoded=True)
    digest = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
