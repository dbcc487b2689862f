"""Near-duplicate vectors: randomised-rotation binary codes with correction factors choose what is computed exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read_table
from .components import components

COSINE = 0.98
#: A pair at the threshold shares no band with this probability at most; a closer pair with far less.
MISS = 1e-6
#: Standard deviations of the unbiased estimate that its confidence bound is wide.
SIGMAS = 6.0
#: Vectors of a bucket that meet at once. A larger bucket is cut in blocks by a hash, and its pairs of blocks are dealt out.
BLOCK = 1024
SEED = 20240501
LEVELS = 127


def shape(n: int, cosine: float) -> tuple[int, int]:
    """(bits of a band, bands): bits follow the number of vectors, so a bucket's size does not; bands follow MISS."""
    bits = max(8, min(32, math.ceil(math.log2(max(n, 2)))))
    return bits, math.ceil(math.log(MISS) / math.log1p(-((1 - math.acos(cosine) / math.pi) ** bits)))


@lru_cache(maxsize=8)
def rotations(dim: int, n_bits: int) -> np.ndarray:
    """dim x n_bits: columns of as many random rotations as n_bits takes. Made once in a process."""
    rng, out = np.random.default_rng(SEED + dim), []
    while sum(q.shape[1] for q in out) < n_bits:
        q, r = np.linalg.qr(rng.standard_normal((dim, dim)))
        out.append(q * np.sign(np.diag(r)))
    return np.concatenate(out, axis=1)[:, :n_bits]


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def blobs(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column."""
    data = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * data.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def rows_of(column: pa.Array, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def codes(reps: DataFrame, dim: int, bits: int, bands: int) -> DataFrame:
    """A written table (id, label, vector, times, code, factor, small, scale, bands) of the unit vectors o of one length.

    code holds the signs c of o's coordinates under the rotations T. x = T c points nearly along o; factor is <x, o>, the correction
    that makes <x, q> / factor an unbiased estimate of <o, q>, and spread is what is left of x across o, divided by
    factor. small and scale are o in whole numbers of LEVELS steps, its part as a query. bands are keys of bits of the code each.
    """
    n_bits = max(bits * bands, dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = rotations(dim, n_bits)
        for batch in batches:
            v = matrix(batch.column(2))
            v = v / np.linalg.norm(v, axis=1, keepdims=True)
            turned = v @ turn
            sign = turned >= 0
            factor = np.abs(turned).sum(axis=1)
            x = np.where(sign, 1.0, -1.0) @ turn.T
            spread = np.sqrt(np.maximum((x * x).sum(axis=1) - factor * factor, 0)) / factor
            scale = np.maximum(np.abs(v).max(axis=1), 1e-300) / LEVELS
            small = np.rint(v / scale[:, None]).astype(np.int8)
            keys = sign[:, : bits * bands].reshape(len(v), bands, bits) @ (1 << np.arange(bits))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * bands), pa.array(keys.ravel()))
            more = [blobs(np.packbits(sign, axis=1)), pa.array(factor), pa.array(spread), blobs(small), pa.array(scale), lists]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "code", "factor", "spread", "small", "scale", "bands"])

    return checkpoint(reps.mapInArrow(run, "id long, label long, vector array<double>, times long, code binary, factor double, spread double, small binary, scale double, bands array<long>"))


def undecided(signs: np.ndarray, factor: np.ndarray, spread: np.ndarray, queries: np.ndarray, off: np.ndarray, cosine: float) -> np.ndarray:
    """Which pairs (o, q) may reach cosine by o's code: signs are o's, queries the rotated whole-number vectors, off how far
    these are from the unit vectors.

    The estimate is <x, q> / factor. Its error is spread times a coordinate of q in a random direction across o, within SIGMAS of which
    the bound lies; no error exceeds spread times the length of q across o.
    """
    dim = max(queries.shape[1], 2)
    s = signs @ queries.T / factor[:, None]
    side = np.sqrt(np.maximum(1 - np.minimum(s, 1) ** 2, 0)) + off[None, :]
    wide = spread[:, None] * np.minimum(SIGMAS / math.sqrt(dim - 1), 1.0) * np.maximum(side, math.sqrt(1 - cosine * cosine))
    return s + wide + (1 + spread[:, None]) * off[None, :] >= cosine - 1e-9


def new_here(keys: np.ndarray, left: np.ndarray, own_band: int) -> np.ndarray:
    """Pairs i < j that share no band before own_band; between left and the others where left marks a part."""
    n = len(keys)
    pairs = np.triu(np.ones((n, n), bool), 1)
    if left.any() and not left.all():
        pairs &= left[:, None] != left[None, :]
    for b in range(own_band):
        pairs &= keys[:, b][:, None] != keys[:, b][None, :]
    return pairs


def groups(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows sorted by their first four columns, by these."""
    rest: list[pa.RecordBatch] = []
    for batch in rows:
        key = np.stack([batch.column(k).to_numpy() for k in range(4)])
        ends = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        if rest and batch.num_rows and any(rest[-1].column(k)[rest[-1].num_rows - 1] != batch.column(k)[0] for k in range(4)):
            yield pa.Table.from_batches(rest)
            rest = []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            if rest and a:
                yield pa.Table.from_batches(rest)
                rest = []
            if b > a:
                rest.append(batch.slice(a, b - a))
    if rest:
        yield pa.Table.from_batches(rest)


def columns(t: pa.Table):
    """A getter of a group's columns, its band, and which of its rows are in its first block."""
    one = lambda c: t.column(c).combine_chunks()
    band, first, second = (t.column(k)[0].as_py() for k in (1, 2, 3))
    return one, band, one("block").to_numpy() == first if first != second else np.ones(t.num_rows, bool)


def choose(rows: Iterator[pa.RecordBatch], dim: int, bits: int, bands: int, cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows of codes -> (bucket, band, first, second, block, id) of the vectors that some pair of their group needs exactly there."""
    n_bits = max(bits * bands, dim)
    turn = rotations(dim, n_bits).astype(np.float32)
    held: list[pa.Table] = []
    names = ["bucket", "band", "first", "second", "block", "id"]
    for t in groups(rows):
        if t.num_rows < 2:
            continue
        one, band, left = columns(t)
        sign = np.unpackbits(rows_of(one("code"), np.uint8), axis=1, count=n_bits)
        pairs = new_here(sign[:, : bits * bands].reshape(len(sign), bands, bits) @ (1 << np.arange(bits)), left, band)
        if not pairs.any():
            continue
        scale = one("scale").to_numpy()
        queries = rows_of(one("small"), np.int8) * scale[:, None]
        off = scale * math.sqrt(dim) / 2
        maybe = undecided((sign * np.float32(2) - np.float32(1)), one("factor").to_numpy(), one("spread").to_numpy(), queries.astype(np.float32) @ turn, off, cosine)
        pairs &= maybe & maybe.T
        hit = np.flatnonzero(pairs.any(axis=0) | pairs.any(axis=1))
        if len(hit):
            held.append(t.select(names).take(hit))
        if len(held) >= 500:
            yield from pa.concat_tables(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.concat_tables(held).combine_chunks().to_batches()


def meet(rows: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Rows of vectors by group -> (id, links, comp) of each vector with a link there, by cosines in double precision.

    links counts a pair in the first band that the two share; comp is the smallest id that links in this group reach.
    """
    ids, links, comps = [], [], []

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (ids, links, comps)], names=["id", "links", "comp"])

    for t in groups(rows):
        if t.num_rows < 2:
            continue
        one, band, left = columns(t)
        own, times, v = one("id").to_numpy(), one("times").to_numpy(), matrix(one("vector"))
        norm = np.sqrt((v * v).sum(axis=1))
        near = (v @ v.T / np.outer(norm, norm) >= cosine) & new_here(one("bands").flatten().to_numpy().reshape(len(own), -1), left, band)
        i, j = np.nonzero(near)
        if not len(i):
            continue
        count = np.bincount(i, times[j], len(own)) + np.bincount(j, times[i], len(own))
        comp = own.copy()
        while True:
            before = comp.copy()
            np.minimum.at(comp, i, before[j])
            np.minimum.at(comp, j, before[i])
            if (comp == before).all():
                break
        hit = np.unique(np.concatenate([i, j]))
        ids.append(own[hit])
        links.append(count[hit].astype(np.int64))
        comps.append(comp[hit])
        if sum(map(len, ids)) > 50_000:
            yield flush()
            ids, links, comps = [], [], []
    if ids:
        yield flush()


def near_vectors(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE) -> DataFrame:
    """One row for each row of table: id, n_links, component_id, kept.

    Rows with a null id or label and vectors that are null, empty, zero or hold null or non-finite components link
    with nothing; a null id has a null component and is kept. Vectors of different lengths never link. Equal vectors of a label are one with a
    multiplicity. Repeated rows count as vectors of their own; those that share an id share its component and the
    largest count among them. Codes alone move to where vectors meet; whole vectors move only to groups in which some pair of theirs
    needs the exact cosine.
    """
    v = F.col(vector_col)
    sound = F.coalesce(F.size(v) > 0, F.lit(False)) & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    good = table.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).where(sound)
    good = checkpoint(good.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(v, lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x).cast("double")).alias("vector")))
    keyed = good.withColumns({"h1": F.xxhash64("vector"), "h2": F.xxhash64(F.lit(7), "vector")})
    reps = checkpoint(keyed.groupBy("label", "h1", "h2").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("times")))
    member = checkpoint(keyed.select("id", "label", "h1", "h2").join(reps, ["label", "h1", "h2"]).select("id", "rep", "times"))
    lone = keyed.join(reps, ["label", "h1", "h2"]).where(F.col("id") == F.col("rep")).dropDuplicates(["label", "h1", "h2"])
    lone = checkpoint(lone.select("id", "label", "vector", "times", F.size("vector").alias("dim")))
    found = None
    for dim, n in sorted(tuple(r) for r in lone.groupBy("dim").agg(F.count(F.lit(1))).collect()):  # a row for each length of vectors
        bits, bands = shape(n, cosine)
        coded = codes(lone.where(F.col("dim") == dim).select("id", "label", "vector", "times"), dim, bits, bands)
        each = coded.select("id", "label", F.posexplode("bands").alias("band", "key")).withColumn("bucket", F.xxhash64("label", "band", "key"))
        each = checkpoint(each.select("id", "bucket", "band"))
        full = checkpoint(each.groupBy("bucket", "band").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
        placed = each.join(full, ["bucket", "band"]).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        placed = placed.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        placed = placed.withColumn("other", other).select("id", "bucket", "band", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"), "block")
        key = ["bucket", "band", "first", "second"]
        dealt = lambda df: df.repartition(*key).sortWithinPartitions(*key, "id")
        light = dealt(placed.join(coded.select("id", "code", "factor", "spread", "small", "scale"), "id").select(*key, "block", "id", "code", "factor", "spread", "small", "scale"))
        some = checkpoint(light.mapInArrow(lambda rows, dim=dim, bits=bits, bands=bands: choose(rows, dim, bits, bands, cosine), "bucket long, band int, first int, second int, block int, id long"))
        whole = dealt(some.join(coded.select("id", "times", "vector", "bands"), "id").select(*key, "block", "id", "times", "vector", "bands"))
        links = checkpoint(whole.mapInArrow(lambda rows: meet(rows, cosine), "id long, links long, comp long"))
        found = links if found is None else checkpoint(found.union(links))
    if found is None:
        found = good.select("id", F.lit(0).cast("long").alias("links"), F.col("id").alias("comp")).limit(0)
    counts = found.groupBy(F.col("id").alias("rep")).agg(F.sum("links").alias("links"))
    tied = found.where("id <> comp").select(F.col("id").alias("a"), F.col("comp").alias("b")).union(member.where("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))).distinct()
    comp = components(tied)
    out = member.join(counts, "rep", "left").groupBy("id").agg(F.max(F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n"))
    out = checkpoint(out.join(comp, out["id"] == comp["node"], "left").select("id", "n", F.coalesce("comp", "id").alias("comp")))
    base = table.select(F.col(id_col).cast("long").alias("__id"))
    at = base.join(out, base["__id"] == out["id"], "left")
    component = F.coalesce("comp", "__id")
    return at.select(F.col("__id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("__id") == component, F.lit(True)).alias("kept"))


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


ORACLE_OP8 = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS x, sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
e AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.n > 0 AND b.n > 0 AND list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.98),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
k AS (SELECT a, min(b) AS b FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n FROM e GROUP BY a)
SELECT vec_id, coalesce(l.n, 0)::BIGINT AS n_links, least(vec_id, coalesce(k.b, vec_id)) AS component_id, vec_id = least(vec_id, coalesce(k.b, vec_id)) AS kept
FROM embeddings LEFT JOIN k ON k.a = vec_id LEFT JOIN l ON l.a = vec_id
"""
