"""Byte strings that an earlier document holds too, found by merging Burrows-Wheeler transforms of shards.

A string of LENGTH bytes counts. Each such window has an anchor, the least hash among its GRAM-byte grams, so equal
windows have equal anchors. Windows of an anchor that only one document has are unique and go no further. The others,
with the bytes they need, meet by anchor in a fixed number of parts of the hash space; a hot anchor's windows meet by
their whole bytes instead, so no part gathers them. A part's segments are made distinct. An anchor of one distinct segment
has nothing to tell apart: its windows are the segment's. Other anchors' segments are cut in shards, each shard's suffixes sorted once, and the shards' transforms merged by refining their
interleave letter by letter, without sorting suffixes of different shards against each other. A letter is STEP bytes, so
LENGTH / STEP refinements order all suffixes by LENGTH bytes; places where blocks split on the way are the common
prefixes, and the blocks left are the repeated intervals. An interval's least document takes the string.

Texts are held in blocks of some MB, compressed; between stages move the blocks, hashes, distinct segments and a bit or
an id for each: a copy or a passage in a third of all documents is one segment a block.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read_table

LENGTH, GRAM, STEP = 50, 20, 5
SPAN = LENGTH - GRAM + 1
#: Rows that move are blocks times parts, so both are as large as an executor's memory allows.
BLOCK = 16_000_000
#: Bytes of text for each part of the hash space, and the least number of parts.
PART, LEAST_PARTS = 24_000_000, 64
SHARDS = 8
#: An anchor found more often than this is hot: its windows go to parts one by one, by a hash of the whole window.
HOT = 10_000
#: Bytes of segments that are merged at once, so few that they stay in the cache; anchors are kept whole.
BATCH = 100_000
#: Windows that are looked at together: their places fit in 16 bits.
PIECE = 1 << 15
U = np.uint64
_BYTES = np.random.default_rng(11).integers(1, 2**32, 256).astype(np.uint32) | np.uint32(1)
_TURN = U(0x9E3779B97F4A7C15)
LAST = np.iinfo(np.int64).max
#: Stands for the least document of a segment whose windows have different ones.
VARIED = np.iinfo(np.int64).min


def squeeze(x: np.ndarray) -> bytes:
    """Sorted or nearly constant integers in few bytes: differences, their bytes by place, zlib."""
    d = np.diff(x.astype(np.int64), prepend=np.int64(0))
    return zlib.compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unsqueeze(b: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(b), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view(np.int64).ravel())


def blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written table (block, rows, ids, sizes, data): documents side by side, about BLOCK bytes or one document a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, count, ids, texts, size = TaskContext.get().partitionId() << 32, 0, [], [], 0

        def flush() -> pa.RecordBatch:
            values = ([own + count], [[LAST if i is None else i for i in ids]], [[i is None for i in ids]], [list(map(len, texts))], [zlib.compress(b"".join(texts), 1)])
            kinds = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.large_binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(values, kinds, strict=True)], names=["block", "ids", "none", "sizes", "data"])

        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                if texts and size + len(t or b"") > BLOCK:
                    yield flush()
                    count, ids, texts, size = count + 1, [], [], 0
                ids.append(i)
                texts.append(t or b"")
                size += len(texts[-1])
        if texts:
            yield flush()

    at = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return checkpoint(at.mapInArrow(run, "block long, ids array<long>, none array<boolean>, sizes array<long>, data binary"))


def sorted_with_order(x: np.ndarray, bits: int = 40) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of that many bits in order, and their places, equal ones by place."""
    if len(x) >> (64 - bits):
        order = np.argsort(x, kind="stable")
        return x[order], order
    key = x.astype(U)
    key <<= U(64 - bits)
    key |= np.arange(len(x), dtype=U)
    key.sort()
    order = (key & U((1 << (64 - bits)) - 1)).view(np.int64)
    key >>= U(64 - bits)
    return key.view(x.dtype), order


def heads_of(x: np.ndarray) -> np.ndarray:
    """True where sorted numbers differ from the one before."""
    out = np.ones(len(x), bool)
    out[1:] = x[1:] != x[:-1]
    return out


def grams(raw: np.ndarray) -> np.ndarray:
    """A hash of 16 bits, the upper half of 32, of the GRAM bytes from each place along the first axis: by it a window chooses its anchor."""
    h = _BYTES[raw]
    for k, turn in ((1, 0x85EBCA6B), (2, 0xC2B2AE35), (4, 0x27D4EB2F), (8, 0x165667B1)):
        h4 = h if k == 4 else None if k < 4 else h4
        x = h[:-k] * np.uint32(turn)
        x += h[k:]
        h = x
    h = h[:-4] * np.uint32(0x9E3779B1)
    h += h4[16:]
    h ^= h >> np.uint32(16)
    h *= np.uint32(0x85EBCA77)
    h &= np.uint32(0xFFFF0000)
    return h


def hash_at(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each of these places of contiguous bytes, over the whole range."""
    eight = np.ndarray((max(len(raw) - 7, 0),), "<u8", raw, strides=(1,))
    x = eight[at] * _TURN
    for k in (8, GRAM - 8):
        x ^= x >> U(32)
        x += eight[at + k]
        x *= U(0xBF58476D1CE4E5B9)
    return spread(x)


def spread(g: np.ndarray) -> np.ndarray:
    """Hashes again, over the whole range."""
    x = g * _TURN
    x = (x ^ (x >> U(32))) * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(29))


def runs(raw: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, windows, doc): successive windows inside a document that share their anchor."""
    ends = np.cumsum(sizes)
    short = np.minimum(sizes, LENGTH - 1)  # the last places of a document start no window
    whole = np.ones(len(raw), bool)
    whole[np.repeat(ends - np.cumsum(short), short) + np.arange(short.sum())] = False
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(len(raw) - LENGTH + 1, 0), PIECE):  # small pieces stay in the cache
        part = raw[at : at + PIECE + LENGTH - 1]
        low, width = grams(part), 1
        low |= np.arange(len(low), dtype=np.uint32)
        while 2 * width <= SPAN:
            low = np.minimum(low[:-width], low[width:])
            width *= 2
        low = np.minimum(low[: len(low) - (SPAN - width)], low[SPAN - width :])
        ok = whole[at : at + len(low)]
        new = np.ones(len(low) + 1, bool)  # a run ends, by its anchor, before such a place
        new[1:-1] = low[1:] != low[:-1]
        head, tail = new[:-1].copy(), new[1:].copy()
        head[1:] |= ~ok[:-1]
        tail[:-1] |= ~ok[1:]
        head, tail = np.flatnonzero(head & ok), np.flatnonzero(tail & ok)
        if len(head):
            anchor = (low[head] & np.uint32(0xFFFF)).astype(np.int64)
            out.append((hash_at(part, anchor) >> U(24), at + head, tail - head + 1))
    if not out:
        return np.zeros(0, U), *(np.zeros(0, np.int64) for _ in range(3))
    h, start, n = (np.concatenate(x) for x in zip(*out, strict=True))
    return h, start, n, np.searchsorted(ends, start, side="right")


def by_part(h: np.ndarray, parts: int) -> np.ndarray:
    """The first place of each part among sorted hashes of 40 bits, and their end."""
    return np.searchsorted((h * U(parts)) >> U(40), np.arange(parts + 1, dtype=U))


def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, dict]]:
    for row in (batch.slice(k, 1).to_pylist()[0] for k in range(batch.num_rows)):
        yield row["block"], np.frombuffer(zlib.decompress(row["data"]), np.uint8), np.array(row["sizes"], np.int64), np.array(row["ids"], np.int64), row


def anchors(held: DataFrame, parts: int) -> DataFrame:
    """(part, block, hashes, twice, counts): a block's distinct anchors in a part, which of them two of its documents have, and how often they come."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw, sizes, _, _ in opened(batch):
                h, _, _, doc = runs(raw, sizes)
                h, order = sorted_with_order(h)
                doc = doc[order]
                first = np.flatnonzero(heads_of(h))
                twice = doc[first] != doc[np.append(first[1:], len(h)) - 1] if len(h) else np.zeros(0, bool)
                counts = np.diff(np.append(first, len(h)))
                h = h[first]
                cut = by_part(h, parts)
                full = [p for p in range(parts) if cut[p + 1] > cut[p]]
                cols = [full, [block] * len(full), [squeeze(h[cut[p] : cut[p + 1]]) for p in full], [np.packbits(twice[cut[p] : cut[p + 1]]).tobytes() for p in full], [squeeze(counts[cut[p] : cut[p + 1]]) for p in full]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "hashes", "twice", "counts"])

    return held.mapInArrow(run, "part int, block long, hashes binary, twice binary, counts binary")


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows sorted by part, by part."""
    rows = (r for b in batches for k in range(0, b.num_rows, 16) for r in b.slice(k, 16).to_pylist())
    for part, group in groupby(rows, key=lambda r: r["part"]):
        yield part, list(group)


def shared(rows: DataFrame, parts: int) -> DataFrame:
    """(block, part, bits, hot): which of a block's anchors in a part more than one document has, and which are hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in grouped(batches):
            own = [unsqueeze(r["hashes"]) for r in group]
            twice = [np.unpackbits(np.frombuffer(r["twice"], np.uint8), count=len(h)).astype(bool) for r, h in zip(group, own, strict=True)]
            every, order = sorted_with_order(np.concatenate(own))
            new = heads_of(every)
            head, group_of = np.flatnonzero(new), np.cumsum(new, dtype=np.int32) - 1
            total = lambda x: np.add.reduceat(np.concatenate(x)[order].astype(np.int64), head)  # noqa: E731, B023
            many = (np.diff(np.append(head, len(every))) > 1) | (total(twice) > 0)
            hot = total([unsqueeze(r["counts"]) for r in group]) > HOT
            ends = np.cumsum(list(map(len, own)))
            back = np.empty(len(every), bool)
            bits, heat = [], []
            for x, out in ((many, bits), (hot, heat)):
                back[order] = x[group_of]
                out += [np.packbits(back[e - len(h) : e]).tobytes() for e, h in zip(ends.tolist(), own, strict=True)]
            cols = ([r["block"] for r in group], [part] * len(group), bits, heat)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "part", "bits", "hot"])

    return rows.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(run, "block long, part int, bits binary, hot binary")


def windows_part(raw: np.ndarray, start: np.ndarray, parts: int) -> np.ndarray:
    """The part of each window that starts there, by a hash of all its bytes."""
    h = np.zeros(len(start), U)
    for k in (0, GRAM, LENGTH - GRAM):
        h = spread(h) + hash_at(raw, start + k)
    return (((spread(h) >> U(24)) * U(parts)) >> U(40)).astype(np.int64)


def open_runs(row: dict, raw: np.ndarray, sizes: np.ndarray, parts: int) -> tuple[np.ndarray, ...]:
    """(part, start, windows, doc) of the runs whose anchor more than one document has; a hot anchor's are single windows."""
    h, start, n, doc = runs(raw, sizes)
    every, order = sorted_with_order(h)
    new = heads_of(every)
    u, at = every[new], np.empty(len(h), np.int64)
    at[order] = np.cumsum(new) - 1
    cut, keep, hot = by_part(u, parts), np.zeros(len(u), bool), np.zeros(len(u), bool)
    for x in row["answers"] or ():
        a, b = cut[x["part"]], cut[x["part"] + 1]
        for out, name in ((keep, "bits"), (hot, "hot")):
            out[a:b] = np.unpackbits(np.frombuffer(x[name], np.uint8), count=b - a)
    hit = np.flatnonzero(keep[at] & ~hot[at]) if len(h) else np.zeros(0, np.int64)
    each = np.flatnonzero(keep[at] & hot[at]) if len(h) else hit
    nth = np.arange(n[each].sum()) - np.repeat(np.cumsum(n[each]) - n[each], n[each])
    single = np.repeat(start[each], n[each]) + nth
    cols = (((h[hit] * U(parts)) >> U(40)).astype(np.int64), windows_part(raw, single, parts)), (start[hit], single), (n[hit], np.ones(len(single), np.int64)), (doc[hit], np.repeat(doc[each], n[each]))
    return tuple(np.concatenate(c) for c in cols)


def distinct_segments(raw: np.ndarray, part: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[dict[int, dict[bytes, int]], np.ndarray]:
    """For each part the distinct segments in order of appearance, and for each run the number of its segment."""
    data, own = raw.tobytes(), np.empty(len(start), np.int64)
    found: dict[int, dict[bytes, int]] = {}
    for k, (p, s, e) in enumerate(zip(part.tolist(), start.tolist(), (start + n + LENGTH - 1).tolist(), strict=True)):
        known = found.setdefault(p, {})
        own[k] = known.setdefault(data[s:e], len(known))
    return found, own


def segments(held: DataFrame, parts: int) -> DataFrame:
    """(part, block, data, sizes, docs): a block's distinct segments of a part, and the least document of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, raw, sizes, ids, row in opened(batch):
                part, start, n, doc = open_runs(row, raw, sizes, parts)
                found, own = distinct_segments(raw, part, start, n)
                cols: list[list] = [[], [], [], [], []]
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                for p, known in found.items():
                    mine = order[cut[p] : cut[p + 1]]
                    least = np.full(len(known), LAST)
                    np.minimum.at(least, own[mine], ids[doc[mine]])
                    for c, v in zip(cols, (p, block, zlib.compress(b"".join(known), 1), bytes(map(len, known)), squeeze(least)), strict=True):
                        c.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["part", "block", "data", "sizes", "docs"])

    return held.mapInArrow(run, "part int, block long, data binary, sizes binary, docs binary")


def transform(letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, transform) of a shard: letters holds its strings one after another, each with a closing 0.

    Ends sort first, by string. Ranks double until all differ; strings are short, so a few times.
    """
    n = len(letters)
    rank = letters + len(sizes)
    rank[np.cumsum(sizes) - 1] = np.arange(len(sizes))
    left = np.repeat(np.cumsum(sizes), sizes) - 1 - np.arange(n)  # letters up to the string's end
    step, bits = 1, n.bit_length()
    while True:
        after = np.minimum(np.arange(n) + np.minimum(step, left), n - 1)
        wide = int(rank.max()).bit_length()
        if 2 * wide + bits <= 64:
            key = (rank.astype(U) << U(wide + bits)) | (rank[after].astype(U) << U(bits)) | np.arange(n, dtype=U)
            key.sort()
            order = (key & U((1 << bits) - 1)).astype(np.int64)
            key >>= U(bits)
        else:
            key = (rank.astype(U) << U(32)) | rank[after].astype(U)
            order = np.argsort(key, kind="stable")
            key = key[order]
        values = np.cumsum(heads_of(key))
        rank = np.empty(n, np.int64)
        rank[order] = values - 1
        if values[-1] == n:
            break
        step *= 2
    first = np.zeros(n, bool)
    first[np.cumsum(sizes) - sizes] = True
    before = np.where(first[order], 0, letters[order - 1])
    return order, before


def interleave(shards: list[np.ndarray], strings: list[int], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Merge the shards' transforms: (source, prefix) after that many refinements.

    source names the shard of each suffix in the order of its first letters, so a shard's suffixes stand in their own
    order; prefix is the number of letters that a suffix shares with the one before, at most rounds. Each
    refinement deals the letters that precede the suffixes out, stably by letter: those suffixes' new order. An
    end is a block of its own.
    """
    bwt, ends = np.concatenate(shards), np.repeat(np.arange(len(shards)), strings)
    source = np.repeat(np.arange(len(shards)), list(map(len, shards))).astype(np.uint8)
    n = len(bwt)
    bwt = bwt.astype(np.uint32)
    group, prefix = np.zeros(n, np.int32), np.full(n, rounds, np.int32)
    prefix[0] = 0
    for k in range(rounds):
        letter = np.empty(n, np.uint32)
        letter[np.argsort(source, kind="stable")] = bwt
        key = (letter.astype(U) << U(32)) | np.arange(n, dtype=U)
        key.sort()
        key = key[len(ends) :]
        order, letter = key.astype(np.uint32), (key >> U(32)).astype(np.uint32)
        new = np.ones(n, bool)
        own = group[order]
        new[len(ends) + 1 :] = (letter[1:] != letter[:-1]) | (own[1:] != own[:-1])
        source = np.concatenate([ends.astype(np.uint8), source[order]])
        group = np.cumsum(new, dtype=np.int32)
        prefix[new & (prefix == rounds)] = k
    return source, prefix


def least_documents(segs: list[bytes], docs: np.ndarray) -> list[np.ndarray]:
    """For each of the distinct segments, the least document of each of its windows."""
    size = np.array(list(map(len, segs)))
    raw = np.frombuffer(b"".join(segs), np.uint8).astype(np.int64)
    base = np.cumsum(size) - size
    value = sum(np.concatenate([raw[k:], np.zeros(k, np.int64)]) << (8 * k) for k in range(STEP))
    value, order = sorted_with_order(value, 8 * STEP)
    code = np.empty(len(raw), np.int64)
    code[order] = np.cumsum(heads_of(value))  # from 1; 0 ends a string
    # Five strings of letters for each segment, from its first five places, segments in SHARDS shards.
    seg = np.repeat(np.arange(len(segs)), STEP)
    phase = np.tile(np.arange(STEP), len(segs))
    count = np.maximum((size[seg] - phase) // STEP, 0)
    shard = (seg * SHARDS) // max(len(segs), 1)
    transforms, strings, where = [], [], []
    for s in range(SHARDS):
        mine = np.flatnonzero(shard == s)
        if not len(mine):
            continue
        length = count[mine] + 1
        string = np.repeat(np.arange(len(mine)), length)
        nth = np.arange(length.sum()) - np.repeat(np.cumsum(length) - length, length)
        place = base[seg[mine]][string] + phase[mine][string] + STEP * nth
        end = nth == length[string] - 1
        letters = np.where(end, 0, code[np.minimum(place, len(code) - 1)])
        order, bwt = transform(letters, length)
        transforms.append(bwt)
        strings.append(len(mine))
        where.append(np.where(end, -1, place)[order])
    source, prefix = interleave(transforms, strings, LENGTH // STEP)
    place = np.empty(len(source), np.int64)
    place[np.argsort(source, kind="stable")] = np.concatenate(where)
    whole = np.zeros(len(raw), bool)
    inner = np.arange(len(raw)) - np.repeat(base, size) <= np.repeat(size, size) - LENGTH
    whole[inner] = True
    owner = np.repeat(docs, size)
    doc = np.where((place >= 0) & whole[place], owner[place], LAST)
    head = np.flatnonzero(prefix < LENGTH // STEP)
    least = np.repeat(np.minimum.reduceat(doc, head), np.diff(np.append(head, len(doc))))
    out = np.full(len(raw), LAST)
    ok = place >= 0
    out[place[ok]] = least[ok]
    return [out[b : b + n - LENGTH + 1] for b, n in zip(base.tolist(), size.tolist(), strict=True)]


def anchor_keys(segs: list[bytes]) -> np.ndarray:
    """The hash of the anchor, which all windows of a segment share, of each segment."""
    out = [np.zeros(0, U)]
    for at in range(0, len(segs), 4096):
        first = np.frombuffer(b"".join(s[:LENGTH] for s in segs[at : at + 4096]), np.uint8)
        anchor = np.argmin(grams(np.ascontiguousarray(first.reshape(-1, LENGTH).T)), axis=0)
        out.append(hash_at(first, np.arange(len(anchor)) * LENGTH + anchor) >> U(24))
    return np.concatenate(out)


def all_least(segs: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """(least, windows): the least document of each segment of a part, or VARIED and by number the least of each of its windows.

    Segments are merged only with those of the same anchor, some anchors at a time; where all have one least document, it is every window's.
    """
    size = np.array(list(map(len, segs)), np.int64)
    least, windows = docs.copy(), {}
    key = anchor_keys(segs)
    key, order = sorted_with_order(key)
    head = np.flatnonzero(heads_of(key))
    if not len(head):
        return least, windows
    longest, count = np.maximum.reduceat(size[order], head), np.diff(np.append(head, len(segs)))
    several = np.minimum.reduceat(docs[order], head) < np.maximum.reduceat(docs[order], head)
    batch, held = [], 0
    for k in np.flatnonzero((count > 1) & (longest > LENGTH) & several).tolist() + [-1]:
        if batch and (k < 0 or held > BATCH):
            mine = np.concatenate(batch)
            for i, x in zip(mine.tolist(), least_documents([segs[i] for i in mine], docs[mine]), strict=True):
                if (x == x[0]).all():
                    least[i] = x[0]
                else:
                    least[i], windows[i] = VARIED, x
            batch, held = [], 0
        if k >= 0:
            batch.append(order[head[k] : head[k] + count[k]])
            held += int(size[batch[-1]].sum())
    return least, windows


def intervals(rows: DataFrame, parts: int) -> DataFrame:
    """(block, part, least, windows): for each of a block's segments in a part the least document that holds it; for each window, where VARIED."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, group in grouped(batches):
            known: dict[bytes, int] = {}
            least: list[int] = []
            numbers = []
            for r in group:
                data, at, own = zlib.decompress(r.pop("data")), 0, []
                for n, d in zip(r["sizes"], unsqueeze(r["docs"]).tolist(), strict=True):
                    k = known.setdefault(data[at : at + n], len(known))
                    at += n
                    own.append(k)
                    if k == len(least):
                        least.append(d)
                    elif d < least[k]:
                        least[k] = d
                numbers.append(np.array(own))
            one, each = all_least(list(known), np.array(least))
            blobs = [squeeze(one[own]) for own in numbers]
            more = [squeeze(np.concatenate([np.zeros(0, np.int64), *(each[k] for k in own[one[own] == VARIED].tolist())])) for own in numbers]
            cols = ([r["block"] for r in group], [part] * len(group), blobs, more)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=["block", "part", "least", "windows"])

    return rows.repartition(parts, "part").sortWithinPartitions("part", "block").mapInArrow(run, "block long, part int, least binary, windows binary")


def removed(held: DataFrame, parts: int, with_text: bool) -> DataFrame:
    """One row for each document: what is removed of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, raw, sizes, ids, row in opened(batch):
                part, start, n, doc = open_runs(row, raw, sizes, parts)
                found, own = distinct_segments(raw, part, start, n)
                edge = np.zeros(len(raw) + LENGTH + 1, np.int8)  # at most LENGTH windows hold a byte
                order = np.argsort(part, kind="stable")
                cut = np.searchsorted(part[order], np.arange(parts + 1))
                for x in row["results"] or ():
                    least, each = unsqueeze(x["least"]), unsqueeze(x["windows"])
                    mine = order[cut[x["part"]] : cut[x["part"] + 1]]
                    varied = least == VARIED
                    odd = varied[own[mine]]
                    hit = mine[~odd & (least[own[mine]] < ids[doc[mine]])]  # all windows of the run
                    np.add.at(edge, start[hit], 1)
                    np.add.at(edge, start[hit] + n[hit] - 1 + LENGTH, -1)
                    mine = mine[odd]
                    count = np.where(varied, np.array(list(map(len, found[x["part"]]))) - LENGTH + 1, 0)
                    at = np.cumsum(count) - count
                    run_of = np.repeat(mine, n[mine])
                    nth = np.arange(len(run_of)) - np.repeat(np.cumsum(n[mine]) - n[mine], n[mine])
                    less = each[at[own[run_of]] + nth] < ids[doc[run_of]]
                    place = start[run_of[less]] + nth[less]
                    np.add.at(edge, place, 1)
                    np.add.at(edge, place + LENGTH, -1)
                gone = np.cumsum(edge[: len(raw)], dtype=np.int8, out=edge[: len(raw)]) > 0
                ends = np.cumsum(sizes)
                begins = ends - sizes
                some = begins[sizes > 0]
                heads, tails = gone.copy(), gone.copy()  # the first and last places of removed runs, which documents' bounds part
                heads[1:] &= ~gone[:-1]
                tails[:-1] &= ~gone[1:]
                heads[some] = gone[some]
                tails[ends[sizes > 0] - 1] = gone[ends[sizes > 0] - 1]
                heads, tails = np.flatnonzero(heads), np.flatnonzero(tails)
                lengths = np.concatenate([[0], np.cumsum(tails - heads + 1)])
                low, high = np.searchsorted(heads, begins), np.searchsorted(heads, ends)
                n_removed = lengths[high] - lengths[low]
                kept = [raw[a:b][~gone[a:b]].tobytes() if g else raw[a:b].tobytes() for a, b, g in zip(begins.tolist(), ends.tolist(), n_removed.tolist(), strict=True)]
                cols = [[None if z else i for i, z in zip(ids.tolist(), row["none"], strict=True)], sizes, n_removed, high - low, [hashlib.sha256(k).hexdigest() for k in kept], kept if with_text else None]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
                k = 6 if with_text else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:k], kinds[:k], strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:k])

    return held.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = True) -> DataFrame:
    """One row for each of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with_text, kept (the remaining bytes).

    Null text is empty. A null id counts as larger than all others. Rows with one id never take from each other. An empty table
    gives an empty table.
    """
    held = blocks(docs, id_col, text_col)
    total = held.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    parts = max(LEAST_PARTS, -(-total // PART))
    bits = checkpoint(shared(anchors(held, parts), parts))
    asked = bits.groupBy("block").agg(F.collect_list(F.struct("part", "bits", "hot")).alias("answers"))
    known = held.join(asked, "block", "left")
    found = checkpoint(intervals(segments(known, parts), parts))
    told = found.groupBy("block").agg(F.collect_list(F.struct("part", "least", "windows")).alias("results"))
    return removed(known.join(told, "block", "left"), parts, with_text)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_suffixes(read_table(spark, sf_dir, "documents").select("doc_id", "text"), with_text=False)


ORACLE_OP2 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 100)) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS s FROM d WHERE n >= 50)),
f AS (SELECT k, min(doc_id) AS least FROM w GROUP BY k),
c AS (SELECT w.doc_id, s FROM w JOIN f USING (k) WHERE least < w.doc_id),
g AS (SELECT doc_id, s, s + 50 AS e, lag(s + 50) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM c),
i AS (SELECT doc_id, s, e, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM g),
r AS (SELECT doc_id, island, min(s) AS a, max(e) AS b FROM i GROUP BY ALL),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM r),
t AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans, max(b) AS z, string_agg((SELECT substr(h, 2 * p.z + 1, 2 * (p.a - p.z)) FROM d WHERE d.doc_id = p.doc_id), '' ORDER BY a) AS head FROM p GROUP BY doc_id)
SELECT d.doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN t USING (doc_id)
"""
