"""Batteries of wrong submissions and sets of correct ones for a table of tasks: one Python stage, then windows."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.functions.candidates import candidates
from scorewright.functions.ids import REFUSALS, canonical_json
from scorewright.functions.programs import RELATIONS, collision, is_reference, is_state, same_program
from scorewright.functions.share import bounded, dealt_evenly, kept
from scorewright.plugins import extended

CANDIDATE = "task_id string, nth int, operator string, detail string, key string, text string, files map<string,string>, commands array<string>, parameters array<string>, ground string, carries boolean, withdrawn boolean"
_S = pa.string()
ARROW = pa.schema({"task_id": _S, "nth": pa.int32(), "operator": _S, "detail": _S, "key": _S, "text": _S, "files": pa.map_(_S, _S), "commands": pa.list_(_S), "parameters": pa.list_(_S), "ground": _S, "carries": pa.bool_(), "withdrawn": pa.bool_()})
CONTROL = pa.schema({"task_id": _S, "nth": pa.int32(), "relation": _S, "text": _S})


def proposed(reference: str, shape: str, more: Callable[[str, str], Iterable]) -> list[tuple]:
    """What CANDIDATE has beside the task, for every proposal to one reference."""
    out = []
    refusing = bool(reference) and any(m in reference.casefold().replace("’", "'") for m in REFUSALS)
    stated = bool(reference) and is_state(reference)
    for nth, c in enumerate(sorted([*candidates(reference, shape), *more(reference, shape)], key=lambda c: c.operator)):
        texts = [c.text] if c.text is not None else list(c.files.values())
        form = {"kind": "workspace", "files": c.files, "commands": c.commands, "parameters": c.parameters}
        key = f"source:{c.text.strip()}" if c.text is not None else f"workspace:{canonical_json(form).decode()}"
        carries = c.ground is not None and bool(reference) and any(is_reference(t, reference) for t in texts)
        withdrawn = c.ground is not None and not carries and (refusing or (stated and c.ground in ("differential", "invariant")))
        out.append((nth, c.operator, c.detail, key, c.text, None if c.files is None else list(c.files.items()), list(c.commands), list(c.parameters), None if withdrawn else c.ground, carries, withdrawn))
    return out


@kept(256)
def own_proposals(reference: str, shape: str) -> list[tuple]:
    return proposed(reference, shape, lambda *_: ())


def proposals(tasks: DataFrame, operators: dict[str, type] | None = None) -> DataFrame:
    """tasks: task_id, shape, reference -> every proposal in order, whether it carries the reference, and its ground as withdrawn
    where the reference is a refusal. operators are those of extensions, plugins.load's, beside the library's own."""
    more = extended(operators) if operators else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                for task, shape, reference in zip(*(b[c].to_pylist() for c in ("task_id", "shape", "reference")), strict=True):
                    ref = reference or ""
                    for x in proposed(ref, shape, more) if more else own_proposals(ref, shape):
                        yield (task, *x)

        # A candidate's texts are about twice its key.
        for rows in bounded(each(), lambda r: 200 + 2 * len(r[4])):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)

    return dealt_evenly(tasks.select("task_id", "shape", "reference")).mapInArrow(run, CANDIDATE)


def battery(tasks: DataFrame, operators: dict[str, type] | None = None) -> DataFrame:
    """The first proposal of each payload that does not carry the reference; one that does claims no payload."""
    first = Window.partitionBy("task_id", "key").orderBy("nth")
    return proposals(tasks, operators).where("NOT carries").withColumn("rank", F.row_number().over(first)).where("rank = 1").drop("rank", "carries")


def battery_counts(tasks: DataFrame, operators: dict[str, type] | None = None) -> DataFrame:
    """For each task: candidates, suppressed (carried the reference before a payload had its first candidate) and withdrawn."""
    won = F.min(F.when(~F.col("carries"), F.col("nth"))).over(Window.partitionBy("task_id", "key"))
    at = proposals(tasks, operators).select("task_id", "key", "nth", "carries", "withdrawn").withColumn("won", won)
    return at.groupBy("task_id").agg(
        F.count_if(~F.col("carries") & (F.col("nth") == F.col("won"))).alias("candidates"),
        F.count_if(F.col("carries") & (F.col("won").isNull() | (F.col("nth") < F.col("won")))).alias("suppressed"),
        F.count_if(F.col("withdrawn") & (F.col("nth") == F.col("won"))).alias("withdrawn"),
    )


def rendered(relation: type, answer: str) -> str | None:
    """What an extension's relation makes of an answer; one that fails makes nothing."""
    try:
        return relation().render(answer)
    except Exception:  # noqa: BLE001
        return None


@kept(256)
def own_controls(reference: str) -> list[tuple]:
    return controls(reference, sorted(RELATIONS), RELATIONS)


def controls(reference: str, names: list[str], every: dict[str, Callable]) -> list[tuple]:
    """The reference, then what every relation makes of it."""
    return [(0, "oracle", reference), *((k + 1, n, x) for k, n in enumerate(names) if (x := every[n](reference)) is not None)]


def positive_controls(tasks: DataFrame, relations: dict[str, type] | None = None) -> DataFrame:
    """The reference of each task that has one, then each distinct certified rewriting, in the relations' order."""
    every = dict(RELATIONS) | {n: partial(rendered, r) for n, r in (relations or {}).items() if n not in RELATIONS}
    names = sorted(every)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for b in batches:
                for task, ref in zip(b["task_id"].to_pylist(), b["reference"].to_pylist(), strict=True):
                    for x in controls(ref, names, every) if relations else own_controls(ref):
                        yield (task, *x)

        for rows in bounded(each(), lambda r: 100 + len(r[3])):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), CONTROL.types, strict=True)], schema=CONTROL)

    made = dealt_evenly(tasks.where("reference <> ''").select("task_id", "reference")).mapInArrow(run, "task_id string, nth int, relation string, text string")
    same = Window.partitionBy("task_id", F.regexp_replace("text", r"\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")).orderBy("nth")
    return made.withColumn("rank", F.row_number().over(same)).where("rank = 1").drop("rank")


def equivalence(pairs: DataFrame) -> DataFrame:
    """pairs (left, right) with the first normalisation that makes them one, and whether they compile to one program."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["collides"] = [collision(x, y) for x, y in zip(b["left"], b["right"], strict=True)]
            b["same_program"] = [same_program(x, y) for x, y in zip(b["left"], b["right"], strict=True)]
            yield b

    return pairs.select("left", "right").mapInPandas(run, "left string, right string, collides string, same_program boolean")


def submission_json(text: str | None, files: dict | None, commands: list, parameters: list) -> str:
    from hashlib import sha256

    seal = lambda x: None if x is None else "sha256:" + sha256(x.encode()).hexdigest()
    if text is not None:
        return json.dumps({"kind": "source", "sha256": seal(text)})
    return json.dumps({"kind": "workspace", "files": {k: seal(v) for k, v in files.items()}, "commands": commands, "parameters": parameters})
