"""A quality classifier by co-training: a view of the text and a view of the page's metadata teach each other.

Every document takes part in every round. Features are written once; a pass over them applies the models of all rounds so far,
which also says which documents the views have labelled for each other, so no state is kept. What comes to the driver has
the model's size: counts by hashed word, a histogram of each view's scores, and rows of fixed width of a bounded
sample of labelled documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read_table

#: Regressions are fitted on at most about so many labelled rows, and so many that a view has labelled, those with the smallest
#: hashes. Word counts, confidence and scores cover all rows.
MAX_LABELLED = 8_000
ROUNDS = 3
#: In a round a view passes on the surest SHARE of all unlabelled documents, in the classes' proportion, and of a class only if,
#: of held-out labelled documents as sure, at least SURE are of it.
SHARE, SURE = 0.1, 0.95
#: Held-out documents that must be as sure before their share says anything.
LEAST_HELD = 5
HASH_BITS = 18
#: Steps of the log-odds from -FAR to FAR in which a view's certainty is counted.
BINS, FAR = 8192, 32.0
#: A word's likelihood ratio between the classes; under chance one word in a hundred thousand reaches it.
MIN_G2 = 20.0
NAMES, PAIRS, SIZES = 64, 256, 16
U = np.uint64
_rng = np.random.default_rng(7)
BYTE, PLACE = (_rng.integers(1, 2**63, n).astype(U) | U(1) for n in (256, 64))
LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
CLASSES = [np.array([test(chr(b)) and b < 128 for b in range(256)]) for test in (str.isupper, str.isdigit, lambda c: c in "#*$%&|<>", lambda c: c in "!?", lambda c: c == "\n", str.isspace)]


def words(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, hashed word) of every distinct word of each text, a run of letters in lower case, and dense features, a row for
    each text: shares and rates only, as the length belongs to the other view."""
    text = text.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    size = np.diff(offsets)
    letter = LETTER[raw]
    start = letter.copy()
    start[1:] &= ~letter[:-1]
    heads = offsets[:-1][size > 0]
    start[heads] = letter[heads]
    at = np.flatnonzero(start)
    spot = np.flatnonzero(letter)
    word = np.cumsum(start)[spot] - 1
    part = BYTE[LOWER[raw[spot]]] * PLACE[(spot - at[word]) & 63] if len(spot) else np.zeros(0, U)
    h = np.add.reduceat(part, np.searchsorted(spot, at)) if len(at) else np.zeros(0, U)
    h = ((h ^ (h >> U(29))) * U(0x9E3779B97F4A7C15)) >> U(64 - HASH_BITS)
    doc = np.searchsorted(offsets, at, side="right") - 1
    n = np.maximum(size, 1)
    many = np.bincount(doc, minlength=len(size))
    dense = [many / n]
    for c in CLASSES:
        total = np.concatenate([[0], np.cumsum(c[raw])])
        dense.append((total[offsets[1:]] - total[offsets[:-1]]) / n)
    pair = np.unique(doc.astype(np.int64) << HASH_BITS | h.astype(np.int64))
    dense.append(np.bincount(pair >> HASH_BITS, minlength=len(size)) / np.maximum(many, 1))
    return pair >> HASH_BITS, pair & ((1 << HASH_BITS) - 1), np.stack(dense, axis=1)


DENSE = 2 + len(CLASSES)


def metadata(lang: np.ndarray, source: np.ndarray, pair: np.ndarray, size: np.ndarray) -> np.ndarray:
    """One-hot hashes of language, source and both together, and the length as steps and as a curve."""
    rows = np.arange(len(lang))
    out = np.zeros((len(lang), 2 * NAMES + PAIRS + SIZES + 2))
    length = np.log2(1 + np.maximum(np.nan_to_num(size), 0))
    for at, width, x in ((0, NAMES, lang), (NAMES, NAMES, source), (2 * NAMES, PAIRS, pair), (2 * NAMES + PAIRS, SIZES, length)):
        out[rows, at + x.astype(np.int64) % width if x is not length else at + np.minimum(length, SIZES - 1).astype(np.int64)] = 1
    out[:, -2], out[:, -1] = length, length**2
    return out


@dataclass
class Logistic:
    """Ridge logistic regression on standardised features, by Newton's steps."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    w: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def fit(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Logistic:
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
        z = np.column_stack([np.clip((x - self.mean) / self.scale, -20, 20), np.ones(len(x))])
        self.w = np.zeros(z.shape[1])
        hold = np.full(z.shape[1], ridge)
        hold[-1] = 1e-3
        for _ in range(25):
            p = sigmoid(z @ self.w)
            g = z.T @ (p - y) + hold * self.w
            step = np.linalg.solve((z * (p * (1 - p) + 1e-6)[:, None]).T @ z + np.diag(hold), g)
            self.w -= step
            if np.abs(step).max() < 1e-6:
                break
        return self

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -20, 20) @ self.w[:-1] + self.w[-1]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def steps(logit: np.ndarray) -> np.ndarray:
    return np.clip((logit + FAR) * (BINS / (2 * FAR)), 0, BINS - 1).astype(np.int64)


@dataclass
class Views:
    """Both views as one round leaves them, calibrated on held-out labels, and how sure each must be to teach the other.

    word holds the words' log-odds from all that the text view knows, and from either half of it for the other half.
    """

    word: list[np.ndarray]
    text: Logistic = field(default_factory=Logistic)
    meta: Logistic = field(default_factory=Logistic)
    calibrate: list[Logistic] = field(default_factory=list)
    #: (from, below) in steps for each view; BINS and 0 where it may not teach.
    sure: list[tuple[int, int]] = field(default_factory=list)
    stack: Logistic = field(default_factory=Logistic)

    def total(self, b: Batch, which: int) -> np.ndarray:
        w = self.word[which][b.word]
        return np.bincount(b.doc, w, b.n)

    def logits(self, b: Batch) -> np.ndarray:
        raw = self.text.logit(np.column_stack([self.total(b, 0), b.dense])), self.meta.logit(b.meta)
        return np.column_stack([c.logit(r[:, None]) for c, r in zip(self.calibrate, raw, strict=True)])


class Batch:
    """Rows of the features' table as arrays."""

    def __init__(self, batch: pa.RecordBatch, targets: tuple[str, ...]):
        col = {n: batch.column(k) for k, n in enumerate(batch.schema.names)}
        self.n = batch.num_rows
        lists = col["words"]
        self.word = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        self.doc = np.repeat(np.arange(self.n), pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64))
        self.dense = col["dense"].flatten().to_numpy(zero_copy_only=False).reshape(self.n, DENSE)
        get = lambda c: col[c].to_numpy(zero_copy_only=False)
        self.names = np.column_stack([get(c).astype(np.float64) for c in ("lang", "source", "pair", "size")]) if self.n else np.zeros((0, 4))
        self.meta = metadata(*self.names.T)
        self.order = get("draw").view(U) if self.n else np.zeros(0, U)
        self.y = {t: get(t).astype(np.float64) for t in targets}

    def held(self) -> np.ndarray:
        """A fifth of all rows teaches no view."""
        return self.order % U(5) == 4

    def half(self) -> np.ndarray:
        return (self.order // U(5) % U(2)).astype(np.int64)


def taught(b: Batch, t: str, history: list[Views]) -> np.ndarray:
    """For each row the labels that the text view and the metadata view learn from, nan for none: its own, or the first that the
    other view was sure of. Held-out rows teach neither."""
    own = np.where(b.held(), np.nan, b.y[t])
    out = np.column_stack([own, own])
    free = np.isnan(b.y[t])
    for v in history:
        if not v.sure:
            continue
        at = steps(v.logits(b))
        for view, other in ((0, 1), (1, 0)):
            high, low = v.sure[view]
            new = free & np.isnan(out[:, other])
            out[new & (at[:, view] >= high), other] = 1.0
            out[new & (at[:, view] < low), other] = 0.0
    return out


def passes(features: DataFrame, targets: tuple[str, ...], state: dict[str, list[Views]], schema: str, one: Callable[[Batch, dict], Iterator[pa.RecordBatch]]) -> DataFrame:
    """features under the models so far, which are broadcast: some MB, whatever the input."""
    held = features.sparkSession.sparkContext.broadcast(state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                yield from one(Batch(whole.slice(k, 2000), targets), held.value)

    return features.mapInArrow(run, schema)


def word_counts(features: DataFrame, targets: tuple[str, ...], state: dict[str, list[Views]]) -> dict[str, np.ndarray]:
    """target -> counts[half, class, word] over every row that the text view learns from, of the words that tell the classes apart
    in a half or in both, and the rows' number in the last place."""
    width = (1 << HASH_BITS) + 1

    def one(b: Batch, history: dict) -> Iterator[pa.RecordBatch]:
        for k, t in enumerate(targets):
            y, half = taught(b, t, history[t])[:, 0], b.half()
            known = ~np.isnan(y)
            cell = np.where(known, 2 * half + np.nan_to_num(y), -1).astype(np.int64)
            at = np.concatenate([cell[b.doc] * width + b.word, cell * width + width - 1])
            keys, n = np.unique(at[at >= 0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k), pa.int32()), pa.array(keys), pa.array(n)], names=["target", "key", "n"])

    each = passes(features, targets, state, "target int, key long, n long", one).select("target", (F.col("key") % width).alias("word"), F.floor(F.col("key") / width).alias("cell"), "n")
    cells = checkpoint(each.groupBy("target", "word").agg(*(F.coalesce(F.sum(F.when(F.col("cell") == c, F.col("n"))), F.lit(0)).cast("double").alias(f"c{c}") for c in range(4))))
    out = {t: np.zeros((4, width)) for t in targets}
    for r in cells.where(F.col("word") == width - 1).collect():
        out[targets[r.target]][:, -1] = r[2:]
    for k, t in enumerate(targets):
        n = out[t][:, -1]
        telling = F.lit(False)
        for own in ((0, 1), (2, 3), (0, 1, 2, 3)):
            b, a = (sum(F.col(f"c{c}") for c in own if c % 2 == y) for y in (0, 1))
            telling = telling | (likelihood(a, b, float(sum(n[c] for c in own if c % 2)), float(sum(n[c] for c in own if c % 2 == 0))) >= MIN_G2 * 0.999)
        for r in cells.where((F.col("target") == k) & (F.col("word") < width - 1) & telling).collect():
            out[t][:, r.word] = r[2:]
    return {t: x.reshape(2, 2, width) for t, x in out.items()}


def likelihood(a: F.Column, b: F.Column, n1: float, n0: float) -> F.Column:
    """A word's likelihood ratio in SQL, so that only words that tell the classes apart leave the cluster."""
    n, m = max(n1 + n0, 1.0), a + b
    cell = lambda o, e: F.when((o > 0) & (e > 0), o * F.ln(o / e)).otherwise(F.lit(0.0))
    return 2 * (cell(a, m * n1 / n) + cell(b, m * n0 / n) + cell(n1 - a, (n - m) * n1 / n) + cell(n0 - b, (n - m) * n0 / n))


def odds(counts: np.ndarray) -> np.ndarray:
    """Log-odds of the words between the classes, where they tell them apart; counts[class, word], rows last."""
    (b, n0), (a, n1) = ((c[:-1], c[-1]) for c in counts)
    n, m = n1 + n0, a + b
    cells = [(a, m * n1 / max(n, 1)), (b, m * n0 / max(n, 1)), (n1 - a, (n - m) * n1 / max(n, 1)), (n0 - b, (n - m) * n0 / max(n, 1))]
    g2 = 2 * sum(np.where(o > 0, o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)), 0) for o, e in cells)
    return np.where(g2 >= MIN_G2, np.log((a + 0.5) / (n1 + 1)) - np.log((b + 0.5) / (n0 + 1)), 0).astype(np.float32)


def sampled(features: DataFrame, targets: tuple[str, ...], state: dict[str, list[Views]], drawn: tuple[float, float]):
    """target -> arrays of the bounded sample: words' sum across halves and from all, dense, names, own label, both views' labels, held.

    drawn are the shares of labelled and of unlabelled rows that are taken, by hash.
    """
    limit = [U(min(int(x * 2**64), 2**64 - 1)) for x in drawn]
    width = 2 + DENSE + 4 + 3 + 1

    def one(b: Batch, history: dict) -> Iterator[pa.RecordBatch]:
        draw = near_random(b.order)
        for k, t in enumerate(targets):
            v, two = history[t][-1], taught(b, t, history[t][:-1])
            own = b.y[t]
            take = np.flatnonzero(np.where(np.isnan(own), ~np.isnan(two).all(axis=1) & (draw <= limit[1]), draw <= limit[0]))
            cross = np.where(b.half() == 0, v.total(b, 2), v.total(b, 1))
            x = np.column_stack([cross, v.total(b, 0), b.dense, b.names, own, two, b.held()])[take]
            rows = pa.ListArray.from_arrays(pa.array(np.arange(len(take) + 1, dtype=np.int32) * width), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(take), k), pa.int32()), pa.array(b.order[take].view(np.int64)), rows], names=["target", "draw", "x"])

    got = passes(features, targets, state, "target int, draw long, x array<double>", one).toPandas().sort_values(["target", "draw"], kind="stable")
    return {t: np.stack(got[got["target"] == k]["x"].to_list()) if (got["target"] == k).any() else np.zeros((0, width)) for k, t in enumerate(targets)}


def near_random(x: np.ndarray) -> np.ndarray:
    """Another hash of the rows' hash, so that the sample is of all halves and fifths alike."""
    x = (x ^ (x >> U(31))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(32))


def fit(v: Views, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fit the views on the sample; (calibrated logits, labels) of its held-out rows."""
    cross, whole, dense, names = x[:, 0], x[:, 1], x[:, 2 : 2 + DENSE], x[:, 2 + DENSE : 6 + DENSE]
    own, for_text, for_meta, held = x[:, -4], x[:, -3], x[:, -2], x[:, -1] > 0
    meta = metadata(*names.T)
    a, b = ~np.isnan(for_text), ~np.isnan(for_meta)
    v.text.fit(np.column_stack([cross, dense])[a], for_text[a])
    v.meta.fit(meta[b], for_meta[b])
    raw = np.column_stack([v.text.logit(np.column_stack([whole, dense])), v.meta.logit(meta)])
    out = held & ~np.isnan(own)
    if out.sum() < 10 or len(set(own[out])) < 2:
        out = ~np.isnan(own)
    v.calibrate = [Logistic().fit(raw[out, k : k + 1], own[out]) for k in (0, 1)]
    return np.column_stack([c.logit(raw[out, k : k + 1]) for k, c in enumerate(v.calibrate)]), own[out]


def histograms(features: DataFrame, targets: tuple[str, ...], state: dict[str, list[Views]]) -> dict[str, np.ndarray]:
    """target -> counts[view, step] over all unlabelled rows that the other view has no label for yet."""

    def one(b: Batch, history: dict) -> Iterator[pa.RecordBatch]:
        for k, t in enumerate(targets):
            sure, two, free = steps(history[t][-1].logits(b)), taught(b, t, history[t][:-1]), np.isnan(b.y[t])
            at = np.concatenate([view * BINS + sure[free & np.isnan(two[:, 1 - view]), view] for view in (0, 1)])
            keys, n = np.unique(at, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), k), pa.int32()), pa.array(keys), pa.array(n)], names=["target", "key", "n"])

    got = passes(features, targets, state, "target int, key long, n long", one).groupBy("target", "key").agg(F.sum("n").alias("n")).collect()
    out = {t: np.zeros(2 * BINS) for t in targets}
    for r in got:
        out[targets[r.target]][r.key] = r.n
    return {t: x.reshape(2, BINS) for t, x in out.items()}


def confidence(counts: np.ndarray, most: float, base: float, at: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """(from, below): the steps from which a view teaches that a document is of the class, and below which that it is not.

    They are the quantiles that leave most documents in the classes' proportion, in whole steps, and hold only where held-out
    documents as sure, of steps at and labels y, bear them out.
    """
    down = np.cumsum(counts)
    up = np.cumsum(counts[::-1])
    n_up, n_down = int(np.searchsorted(up, most * base, side="right")), int(np.searchsorted(down, most * (1 - base), side="right"))
    high, low = BINS - n_up, n_down
    borne = lambda found, label: found.sum() >= LEAST_HELD and (y[found] == label).mean() >= SURE
    return (high if borne(at >= high, 1) else BINS), (low if borne(at < low, 0) else 0)


def co_train(features: DataFrame, targets: tuple[str, ...], max_labelled: int = MAX_LABELLED) -> tuple[dict[str, Views | float], list[dict]]:
    """The views of each target, or the labels' mean where they are not of both classes, and what each round passed on."""
    seen = features.agg(F.count(F.lit(1)).alias("rows"), *(e for t in targets for e in (F.count(t).alias(f"{t}_n"), F.sum(t).alias(f"{t}_sum")))).first()
    known = {t: seen[f"{t}_n"] for t in targets}
    mean = {t: float(seen[f"{t}_sum"]) / known[t] if known[t] else 0.5 for t in targets}
    both = tuple(t for t in targets if 0 < mean[t] < 1 and known[t] > 1)
    state: dict[str, list[Views]] = {t: [] for t in both}
    log: list[dict] = []
    most = {t: SHARE * (seen["rows"] - known[t]) for t in both}
    drawn = (max_labelled / max([known[t] for t in both] or [1]), max_labelled / max(seen["rows"] * SHARE * ROUNDS * 2, 1))
    for k in range(ROUNDS + 1 if both else 0):
        counts = word_counts(features, both, state)
        for t in both:
            state[t].append(Views([odds(counts[t].sum(axis=0)), odds(counts[t][0]), odds(counts[t][1])]))
        rows = sampled(features, both, state, drawn)
        held = {t: fit(state[t][-1], rows[t]) for t in both}
        for t in both:
            del state[t][-1].word[1:]  # the halves' own weights have served
        if k == ROUNDS:
            for t in both:
                state[t][-1].stack.fit(*held[t])
            break
        bins = histograms(features, both, state)
        for t in both:
            at = steps(held[t][0])
            state[t][-1].sure = [confidence(bins[t][view], most[t], mean[t], at[:, view], held[t][1]) for view in (0, 1)]
            for view in (0, 1):
                high, low = state[t][-1].sure[view]
                log.append({"round": k, "target": t, "view": ("text", "meta")[view], "up": float(bins[t][view][high:].sum()), "down": float(bins[t][view][:low].sum())})
    return {t: state[t] if t in both else mean[t] for t in targets}, log


def written(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...]) -> DataFrame:
    """A written table of one row for each of docs: features of both views, and each target's label, null where there is none.

    Of labels with one id the largest counts. draw is a hash of the id and the text, so equal rows fall alike.
    """
    named = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("__l")).agg(*(F.max(t).alias(t) for t in targets))
    at = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", F.col("n_chars").cast("double").alias("n_chars"))
    at = at.join(F.broadcast(named) if named.count() <= 1_000_000 else named, at["doc_id"] == named["__l"], "left")
    name = lambda *c: F.pmod(F.xxhash64(*(F.coalesce(x, F.lit("\0")) for x in c)), F.lit(1 << 30)).cast("int")
    at = at.select("doc_id", "text", name("lang").alias("lang"), name("source").alias("source"), name("lang", "source").alias("pair"), F.col("n_chars").alias("size"), F.xxhash64("doc_id", "text").alias("draw"), *(F.col(t).cast("double").alias(t) for t in targets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1000):
                batch = whole.slice(k, 1000)
                doc, word, dense = words(batch.column(1))
                ends = np.searchsorted(doc, np.arange(batch.num_rows + 1))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(word, pa.int32()))
                wide = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * DENSE), pa.array(dense.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, wide, *batch.columns[2:]], names=["doc_id", "words", "dense", *batch.schema.names[2:]])

    return checkpoint(at.mapInArrow(run, "doc_id long, words array<int>, dense array<double>, lang int, source int, pair int, size double, draw long, " + ", ".join(f"{t} double" for t in targets)))


def score(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic"), max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id and, for each target, <target>_text, <target>_meta (calibrated views) and <target>_score (their combination).

    docs has doc_id, text, lang, source, n_chars; other columns are ignored. Null text is empty, null metadata a
    value of its own; a row with a null id is scored like any other and has no label. Repeated rows get equal scores, and each
    counts. Without labels of both classes every score is the labels' mean, one half without any. An empty table gives an
    empty table.
    """
    features = written(docs, labels, targets)
    models, _ = co_train(features, targets, max_labelled)
    ids = features.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 2000):
                part = whole.slice(k, 2000)
                b, out = Batch(part, targets), []
                for m in ids.value.values():
                    if isinstance(m, float):
                        out += [np.full(b.n, m)] * 3
                    else:
                        two = m[-1].logits(b)
                        out += [sigmoid(two[:, 0]), sigmoid(two[:, 1]), sigmoid(m[-1].stack.logit(two))]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(x) for x in out)], names=["doc_id", *names])

    names = [f"{t}_{v}" for t in targets for v in ("text", "meta", "score")]
    return features.mapInArrow(run, "doc_id long, " + ", ".join(f"{n} double" for n in names))


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    out = score(docs.select("doc_id", "text", "lang", "source", "n_chars"), labels.select("doc_id", "quality", "toxic"))
    return out.withColumn("kept", (F.col("quality_score") >= 0.5) & (F.col("toxic_score") < 0.5))
