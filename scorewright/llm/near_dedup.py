"""Near-duplicates by weighted Jaccard: BagMinHash signatures, bands, exact multiset overlap, components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read_table
from .components import components

SHINGLE = 5
SLOTS, ROWS, BANDS = 128, 5, 25
#: A pair of this similarity meets in some band with probability 1 - (1 - 0.8**5)**25 = 0.99995.
NUM, DEN = 4, 5
#: The last round's sketches: four bits of each of so many slots. At the similarity a slot of two sketches agrees with
#: probability 0.8 + 0.2 / 16; such a pair differs in more than MOST_DIFFERENT slots with probability 1e-9, next to nothing beside the bands' 5e-5.
SKETCH, MOST_DIFFERENT = 1024, 267
#: Sets of at most so many ids (8 bytes each) are broadcast to choose which texts move; larger ones are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
U = np.uint64
DOC_BITS = 20
GOLDEN = U(0x9E3779B97F4A7C15)


def times(k: int) -> np.uint64:
    return U(k * int(GOLDEN) % 2**64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that looks random."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(words: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """(doc, hash) of every shingle occurrence of a batch of word-hash lists; fewer than five words make one shingle."""
    flat = words.flatten().to_numpy(zero_copy_only=False).view(U)
    offsets = words.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    n = np.diff(offsets)
    made = np.where(n >= SHINGLE, n - SHINGLE + 1, (n > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(n)), made)
    at = np.repeat(offsets[:-1] - np.concatenate([[0], np.cumsum(made)[:-1]]), made) + np.arange(len(doc))
    length = np.minimum(n, SHINGLE)[doc]
    out = length.astype(U) * GOLDEN
    top = max(len(flat) - 1, 0)
    for k in range(SHINGLE):
        out = np.where(k < length, mix(out ^ flat[np.minimum(at + k, top)]) + GOLDEN, out)
    return doc, out


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, hash, weight) of the distinct shingles, by doc and hash, of fewer than 2**DOC_BITS docs; the hash keeps the other bits."""
    bits = U(DOC_BITS)
    key = (doc.astype(U) << (U(64) - bits)) | (h >> bits)
    key.sort()
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[at] >> (U(64) - bits)).astype(np.int64), mix((key[at] << bits) + GOLDEN), np.diff(np.append(at, len(key)))


def bag_min_hash(doc: np.ndarray, h: np.ndarray, w: np.ndarray, n_docs: int, slots: int = SLOTS) -> np.ndarray:
    """n_docs x slots signatures (words of 64 bits) whose slots agree with the probability of the weighted Jaccard similarity.

    Weights are discretised at the integers. An element's process lives on time x weight level, split in dyadic
    blocks (0, 1], (1, 2], (2, 4], ...: a block of length r is one Poisson process of rate r, made from the element
    and the block alone, whose points fall on a level of the block and count only where the weight reaches it.
    So blocks wholly under the weight keep all points and only the topmost is thinned. A slot takes its
    earliest point. Points come in the order of time and stop at a bound near the time at which the document's
    slots are full; documents with an empty slot run again with twice the bound.
    """
    total = np.bincount(doc, w, n_docs)
    bound = np.where(total > 0, slots * (np.log(slots) + 5) / np.maximum(total, 1), 0)
    level = [np.zeros(len(doc), np.int64)]
    owner = [np.arange(len(doc))]
    k = 1
    while (big := np.flatnonzero(w > (1 << (k - 1)))).size:
        owner.append(big)
        level.append(np.full(len(big), k))
        k += 1
    owner_all, level_all = np.concatenate(owner), np.concatenate(level)
    best = np.full(n_docs * slots, np.inf)
    ids = np.zeros(n_docs * slots, U)
    todo = np.flatnonzero(total > 0)
    pick = np.arange(len(owner_all))
    while len(todo):
        own, lev = owner_all[pick], level_all[pick]
        key = mix(h[own] + mix(lev.astype(U) + GOLDEN))
        base = np.where(lev == 0, 0, 1 << np.maximum(lev - 1, 0))
        rate = np.where(lev == 0, 1, base)
        d, room = doc[own], w[own] - base
        limit, x, i = bound[d], np.zeros(len(own)), 0
        while len(key):
            i += 1
            u = mix(key + times(i))
            x = x - np.log1p(-(u >> U(11)).astype(np.float64) * 2.0**-53) / rate
            live = x <= limit
            if not live.all():
                key, u, x, rate, d, room, limit = key[live], u[live], x[live], rate[live], d[live], room[live], limit[live]
            v = mix(u ^ GOLDEN)
            counts = ((v >> U(20)) % rate.astype(U)).astype(np.int64) < room
            cell, when = d[counts] * slots + (v[counts] & U(slots - 1)).astype(np.int64), x[counts]
            np.minimum.at(best, cell, when)
            won = best[cell] == when
            ids[cell[won]] = u[counts][won]
        empty = np.isinf(best.reshape(n_docs, slots)[todo]).any(axis=1)
        todo = todo[empty]
        bound[todo] *= 2
        again = np.zeros(n_docs, bool)
        again[todo] = True
        pick = np.flatnonzero(again[doc[owner_all]])
    return ids.reshape(n_docs, slots)


def word_hashes(text) -> F.Column:
    return F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), ""), lambda w: F.xxhash64(w))


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written table (id, weight, c1, c2, bands): a row for each of docs with an id and a word.

    c1 and c2 hash the multiset of shingles; bands are hashes of ROWS slots each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            words = pa.chunked_array([whole.column(1)]).combine_chunks()
            ends = np.cumsum(pa.compute.list_value_length(words).to_numpy(zero_copy_only=False))
            at = 0
            while at < whole.num_rows:  # about 300,000 words at a time, or one document
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 300_000)))
                part = whole.slice(at, to - at)
                at = to
                doc, h = shingles(part.column(1))
                weight = np.bincount(doc, minlength=part.num_rows)
                edge = np.searchsorted(doc, np.arange(part.num_rows + 1))
                c1, c2 = (np.diff(np.concatenate([[U(0)], np.cumsum(x)])[edge]) for x in (mix(h + U(1)), mix(h ^ U(0xD6E8FEB86659FD93))))
                sig = bag_min_hash(*counted(doc, h), part.num_rows)
                bands = np.empty((part.num_rows, BANDS), U)
                for b in range(BANDS):
                    x = np.full(part.num_rows, times(b + 1))
                    for r in range(ROWS):
                        x = mix(x ^ sig[:, b * ROWS + r]) + GOLDEN
                    bands[:, b] = x
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS), pa.array(bands.view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(weight, pa.int64()), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)), lists], names=["id", "weight", "c1", "c2", "bands"])

    at = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), word_hashes(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    return checkpoint(at.mapInArrow(run, "id long, weight long, c1 long, c2 long, bands array<long>"))


def overlap(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written table of the pairs (a, b) whose multisets of shingles overlap by NUM / DEN at least.

    Only texts of documents in a pair move. A document in many pairs is one row on its side of the join, whose
    other side Spark can split.
    """
    ids = checkpoint(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = texts_of(ids, docs, id_col, text_col)
    one = pairs.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    two = one.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: dict[int, np.ndarray] = {}  # a hub's pairs come together, and its members come again with other hubs

        def once(doc: int, words: pa.ListArray) -> np.ndarray:
            if doc not in recent:
                new = numbered(shingles(words)[1])
                if len(recent) >= 256 or sum(map(len, recent.values())) + len(new) > 4_000_000:
                    recent.clear()
                recent[doc] = new
            return recent[doc]

        for batch in batches:
            keep = []
            for at in range(batch.num_rows):
                x, y = (once(batch.column(c)[at].as_py(), batch.column(c + 2).slice(at, 1)) for c in (0, 1))
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                keep.append(DEN * same >= NUM * (len(x) + len(y) - same))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return checkpoint(two.select("a", "b", word_hashes(F.col("text_a")).alias("x"), word_hashes(F.col("text_b")).alias("y")).mapInArrow(run, "a long, b long"))


def texts_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the documents that ids, a written table, names; a small set of ids is broadcast, so only their texts move."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "id", "left_semi").dropDuplicates(["id"])


def sketches(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A written table (id, weight, s0, s1, ...) of longer signatures in four bits a slot, for the documents of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                doc, h = shingles(part.column(1))
                sig = bag_min_hash(*counted(doc, h), part.num_rows, SKETCH)
                small = ((sig & U(15)).reshape(part.num_rows, SKETCH // 16, 16) << (np.arange(16, dtype=U) * U(4))).sum(axis=2, dtype=U).view(np.int64)
                weight = np.bincount(doc, minlength=part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(weight, pa.int64()), *(pa.array(np.ascontiguousarray(c)) for c in small.T)], names=["id", "weight", *names])

    names = [f"s{k}" for k in range(SKETCH // 16)]
    ids = checkpoint(ids.distinct())
    at = texts_of(ids, docs, id_col, text_col).select("id", word_hashes(F.col("text")).alias("words"))
    return checkpoint(at.mapInArrow(run, "id long, weight long, " + ", ".join(f"{n} long" for n in names)))


def different(x: str, y: str) -> F.Column:
    """In how many slots the sketches of two sides of a join differ: nibbles that are not zero after an exclusive or."""
    total = F.lit(0)
    for k in range(SKETCH // 16):
        z = F.col(f"{x}.s{k}").bitwiseXOR(F.col(f"{y}.s{k}"))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(F.lit(0x1111111111111111))
        total = total + F.bit_count(z)
    return total


def first_met(x: str, y: str) -> F.Column:
    """Whether the band of a join is the first that its two sides share, so that each pair comes once."""
    met = F.array_position(F.zip_with(F.col(f"{x}.bands"), F.col(f"{y}.bands"), lambda a, b: a == b), True)
    return F.get(F.col(f"{x}.bands"), (met - 1).cast("int")) == F.col(f"{x}.band")


def numbered(h: np.ndarray) -> np.ndarray:
    """A multiset as a set: each occurrence hashed with its number among its equals."""
    h = np.sort(h)
    start = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    rank = np.arange(len(h)) - np.maximum.accumulate(np.where(start, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
    return mix(h ^ mix(rank.astype(U) + GOLDEN))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table (id, class_id) of every id that has a word, class_id the smallest id linked directly or by others.

    Equal multisets are one representative from the start. Then two rounds of verification: a document with the
    hub of each of its bands, the one in the band that meets the most documents over all bands; then
    documents of still different classes that share a band and whose weights and sketches allow the
    similarity. Every pair that shares a band ends in one class, is compared, or is ruled out by weights or
    sketches; only pairs that pass both are listed, each once.
    Null ids and texts without a word are in no class. Rows with one id are one document, read as any of them.
    """
    sig = signatures(docs, id_col, text_col)
    reps = checkpoint(sig.groupBy("c1", "c2").agg(F.min("id").alias("id")))
    member = checkpoint(sig.select("id", "c1", "c2").join(reps.withColumnRenamed("id", "rep"), ["c1", "c2"]).select("id", "rep"))
    own = sig.join(reps.select("id"), "id", "left_semi").dropDuplicates(["id"])
    each = own.select("id", F.explode("bands").alias("band"))
    full = checkpoint(each.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    met = each.join(full, "band")
    score = checkpoint(met.groupBy("id").agg(F.sum("n").alias("score")))
    met = checkpoint(met.select("band", "id"))
    hub = checkpoint(met.join(score, "id").groupBy("band").agg(F.max(F.struct("score", (-F.col("id")).alias("neg"))).alias("hub")).select("band", (-F.col("hub.neg")).alias("hub")))
    far = checkpoint(met.join(hub, "band").where("id <> hub").select("id", "hub").distinct())
    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    tested = checkpoint(far.select(*pair(F.col("id"), F.col("hub"))).distinct())
    links = overlap(tested, docs, id_col, text_col)
    comp = components(links)

    def label(df: DataFrame, col: str) -> DataFrame:
        named = comp.select(F.col("node").alias(col), F.col("comp").alias(f"comp_{col}"))
        return df.join(named, col, "left").withColumn(f"comp_{col}", F.coalesce(f"comp_{col}", col))

    placed = checkpoint(label(met, "id"))
    mixed = placed.groupBy("band").agg(F.min("comp_id").alias("lo"), F.max("comp_id").alias("hi")).where("lo <> hi").select("band")
    open_ = checkpoint(placed.join(mixed, "band", "left_semi"))
    open_ = checkpoint(open_.join(sketches(open_.select("id"), docs, id_col, text_col), "id").join(own.select("id", "bands"), "id"))
    x, y = open_.alias("x"), open_.alias("y")
    third = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.comp_id") != F.col("y.comp_id")) & (DEN * F.least("x.weight", "y.weight") >= NUM * F.greatest("x.weight", "y.weight")) & (different("x", "y") <= MOST_DIFFERENT) & first_met("x", "y"))
    third = checkpoint(third.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(tested, ["a", "b"], "left_anti"))
    links = checkpoint(links.union(overlap(third, docs, id_col, text_col)))
    comp = components(links)
    out = member.join(comp, member["rep"] == comp["node"], "left")
    return checkpoint(out.groupBy("id").agg(F.min(F.coalesce("comp", "rep")).alias("class_id")))


def dedup_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose class has a smaller id; rows that repeat the kept id stay."""
    gone = classes(docs, id_col, text_col).where("id <> class_id").select(F.col("id").alias("__gone"))
    gone = checkpoint(gone)
    small = gone.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if small else gone, docs[id_col] == F.col("__gone"), "left_anti")


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    named = classes(docs)
    out = docs.select("doc_id").join(named, docs["doc_id"] == named["id"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True)).alias("kept"))


ORACLE_OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(words) - 3, 2)), lambda i: array_to_string(words[i:i+4], ' '))) AS s FROM w WHERE len(words) > 0),
c AS (SELECT doc_id, s, count(*) AS n FROM g GROUP BY ALL),
t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS same FROM c x JOIN c y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o JOIN t ta ON a = ta.doc_id JOIN t tb ON b = tb.doc_id WHERE 5 * same >= 4 * (ta.total + tb.total - same)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a AS doc_id, least(a, min(b)) AS class_id FROM r GROUP BY a)
SELECT d.doc_id, coalesce(k.class_id, d.doc_id) AS class_id, coalesce(k.class_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN k USING (doc_id)
"""
