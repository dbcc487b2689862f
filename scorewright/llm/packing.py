"""Documents as token pieces, packed into sequences by bounded-space online best-fit."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, read_table

CAPACITY = 2048
#: A longer run of white space overflows the stack of the faster encoder's pattern; such texts take the file's own encoder.
LONGEST_BLANK = 50_000
#: Bins that one packer holds open; each has at most CAPACITY tokens' worth of places, so a packer's memory is bounded.
OPEN_BINS = 8192
#: Pieces that one packer takes. They arrive longest first, so OPEN_BINS is enough for them unless nearly all are longer
#: than half a sequence; the only loss against packing all together is the last bin or two of each packer.
PIECES = 16_384


@lru_cache(maxsize=4)
def encoder(path: str):
    """text -> uint32 ids for a byte-level BPE file of the tokenizers library.

    Where the file's merges are in the order of their ids and it has the usual split and added tokens, the same
    vocabulary runs in tiktoken, which gives equal ids several times faster; any other file runs as it is.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)

    def own(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab, merges = model.get("vocab", {}), [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    plain = all(not (x.get("lstrip") or x.get("rstrip") or x.get("single_word") or x.get("normalized")) or x["content"] == "<|endoftext|>" for x in spec.get("added_tokens", []))
    ordered = len(vocab) - len([x for x in special if x in vocab]) == 256 + len(merges) and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(merges))
    if pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and not spec.get("normalizer") and plain and ordered:
        import tiktoken

        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items() if t not in special}
        split = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        fast = tiktoken.Encoding("own", pat_str=split, mergeable_ranks=ranks, special_tokens=special)
        blank = re.compile(rf"\s{{{LONGEST_BLANK}}}")
        return lambda text: own(text) if len(text) > LONGEST_BLANK and blank.search(text) else fast.encode_to_numpy(text, allowed_special="all")
    return own


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole capacities at the end, the rest, if any, first."""
    first = n % capacity or capacity
    return [(0, min(first, n))] + [(s, capacity) for s in range(first, n, capacity)]


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): one row a piece. Null text is empty: the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out: list[list] = [[], [], [], [], [], []]
                for doc, text in zip(part.column(0), part.column(1).to_pylist(), strict=True):
                    ids = np.append(encode(text or ""), np.uint32(end_id)).astype("<u4")
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        own = ids[start : start + length]
                        for column, v in zip(out, (doc.as_py(), k, start, length, zlib.crc32(own.tobytes()), own.astype("<i4") if with_ids else None), strict=True):
                            column.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)][: 6 if with_ids else 5], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if with_ids else 5])

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, kind)


class BestFit:
    """Online best-fit with a fixed number of open bins.

    Open bins hang in a bitset keyed by free space: bit f is set while some open bin has f tokens free. A piece of
    length n takes the lowest set bit from n up, the fullest bin that it fits; when none fits and all bins
    are open, the lowest set bit of all, the fullest bin, is closed first.
    """

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.left, self.mask, self.free, self.bins = capacity, open_bins, 0, {}, 0

    def take(self, f: int) -> int:
        stack = self.free[f]
        b = stack.pop()
        if not stack:
            self.mask ^= 1 << f
        return b

    def put(self, length: int) -> tuple[int, int]:
        """The bin and the offset there of a piece of this length."""
        fits = self.mask >> length
        if fits:
            f = length + (fits & -fits).bit_length() - 1
            b = self.take(f)
        else:
            if not self.left:
                self.take((self.mask & -self.mask).bit_length() - 1)
                self.left += 1
            b, f = self.bins, self.capacity
            self.bins += 1
            self.left -= 1
        rest = f - length
        if rest:
            self.free.setdefault(rest, []).append(b)
            self.mask |= 1 << rest
        else:
            self.left += 1
        return b, self.capacity - f


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """cut_pieces, a written table, with sequence_id and offset.

    Packers get equal shares by a hash of all of a piece's fields, sorted longest first, so a rerun of a lost
    task packs alike. Repeated rows are packed each on its own. An empty table gives an empty table.
    """
    n = max(1, -(-cut_pieces.count() // PIECES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, fit = TaskContext.get().partitionId() << 40, BestFit(capacity, open_bins)
        for batch in batches:
            placed = [fit.put(x) for x in batch.column("length").to_pylist()]
            extra = [pa.array([own + b for b, _ in placed], pa.int64()), pa.array([o for _, o in placed], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "sequence_id", "offset"])

    kind = ", ".join(f"{c} {t}" for c, t in cut_pieces.dtypes) + ", sequence_id long, offset long"
    return cut_pieces.repartition(n, "doc_id", "piece").sortWithinPartitions(F.desc("length"), "doc_id", "piece", "start", "ids_crc32").mapInArrow(run, kind)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pack_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False) -> DataFrame:
    """Tokenize docs with the file at path (the same on every executor) and pack the pieces."""
    return pack(checkpoint(pieces(docs, path or tokenizer_path(), with_ids=with_ids)))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
