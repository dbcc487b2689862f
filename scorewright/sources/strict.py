"""JSON Lines read strictly: every line numbered in its file, every field checked, the first bad line named.

Lines are numbered without an ordering shuffle: each split of a file counts its lines, and the counts of the splits
before it are added. The check of a line is Python's own reading of JSON, in Arrow batches.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorewright.functions.ids import PATTERNS
from scorewright.functions.share import dealt_evenly

_MISSING = object()


@dataclass(frozen=True)
class Field:
    """kind: text, integer, number, boolean. null is allowed only where nullable; an optional field may be left out, not null."""

    kind: str
    required: bool = True
    nullable: bool = False
    default: Any = None
    least: float | None = None
    above: float | None = None
    among: tuple[str, ...] = ()
    pattern: str | None = None
    blank: bool = False

    def problem(self, v: Any) -> str | None:
        if v is None:
            return None if self.nullable else "is null"
        if self.kind == "text":
            if not isinstance(v, str):
                return "is not text"
            if not v and not self.blank:
                return "is empty"
            if self.among and v not in self.among:
                return f"is none of {', '.join(self.among)}"
            return None if self.pattern is None or re.fullmatch(self.pattern, v) else "is malformed"
        if self.kind == "boolean":
            return None if isinstance(v, bool) else "is not true or false"
        if isinstance(v, bool) or not isinstance(v, int if self.kind == "integer" else (int, float)):
            return f"is not {'an integer' if self.kind == 'integer' else 'a number'}"
        try:
            if not math.isfinite(float(v)):
                return "is not finite"
        except OverflowError:
            return "is not finite"
        if self.least is not None and v < self.least:
            return f"is below {self.least:g}"
        return f"is not above {self.above:g}" if self.above is not None and v <= self.above else None


@dataclass(frozen=True)
class Spec:
    fields: dict[str, Field]
    extras: bool = False
    empty: bool = True
    #: (a, b): where b is true, a must be.
    implies: tuple[tuple[str, str], ...] = ()

    def read(self, text: str) -> tuple[dict[str, Any], str | None]:
        try:
            data = json.loads(text)
        except (ValueError, RecursionError):
            return {}, "not JSON"
        if not isinstance(data, dict):
            return {}, "not an object"
        extra = sorted(set(data) - set(self.fields))
        if extra and not self.extras:
            return {}, f"unknown field {extra[0]}"
        out = {}
        for name, f in self.fields.items():
            v = data.get(name, _MISSING)
            if v is _MISSING:
                if f.required:
                    return {}, f"{name} is missing"
                out[name] = f.default
                continue
            if wrong := f.problem(v):
                return {}, f"{name} {wrong}"
            out[name] = float(v) if f.kind == "number" and v is not None else v
        for a, b in self.implies:
            if out[b] and not out[a]:
                return {}, f"{b} without {a}"
        return out, None


TEXT, FLAG = Field("text"), Field("boolean")
RESULTS = Spec({"task_id": TEXT, "model": TEXT, "score": Field("number", nullable=True), "max_score": Field("number", required=False, default=1.0, above=0), "cluster": Field("text", required=False), "sample": Field("integer", required=False, least=0)}, extras=True, empty=False)
OUTCOMES = Spec({"finding": Field("text", pattern=PATTERNS["finding"]), "probe": Field("text", pattern=PATTERNS["probe"]), "battery": Field("integer", least=1), "level": Field("text", among=("proven", "proven-experimental")), "outcome": Field("text", among=("stands", "disputed", "withdrawn-after-dispute", "contradicted-by-fixture")), "dismissed": FLAG})
PLANTED = Spec({"weakness": Field("text", pattern=PATTERNS["weakness"]), "instance": TEXT, "tried": FLAG, "accepted": FLAG, "proven": FLAG, "method": Field("text", required=False)}, implies=(("tried", "accepted"), ("accepted", "proven")))
TYPES = {"text": "string", "integer": "long", "number": "double", "boolean": "boolean"}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text): every line, blank ones too, numbered from 1 in its file."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("text"))
    splits = raw.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    return raw.join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "text")


def read_lines(spark: SparkSession, path: str, spec: Spec) -> DataFrame:
    """(file, line, error, fields): blank lines are left out; error is null where the line is sound."""
    return checked(numbered_lines(spark, path), spec)


def checked(lines: DataFrame, spec: Spec) -> DataFrame:
    """The same for lines (file, line, text) from anywhere."""
    names = list(spec.fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, line, text in b.itertuples(index=False):
                values, error = spec.read(text)
                rows.append((file, line, error, *(values.get(n) for n in names)))
            out = pd.DataFrame(rows, columns=["file", "line", "error", *names])
            yield out.astype({n: "Int64" for n, f in spec.fields.items() if f.kind == "integer"})

    kind = "file string, line long, error string, " + ", ".join(f"{n} {TYPES[f.kind]}" for n, f in spec.fields.items())
    return dealt_evenly(lines.select("file", "line", "text").where(F.length(F.trim(F.col("text"), F.lit(" \t\r\x0b\x0c"))) > 0)).mapInPandas(run, kind)


def read_sound(spark: SparkSession, path: str, spec: Spec) -> DataFrame:
    """The rows without file and error; ValueError naming the first bad line, or for an empty file where the format needs a row."""
    rows = read_lines(spark, path, spec)
    bad = rows.where("error IS NOT NULL").orderBy("file", "line").limit(1).collect()
    if bad:
        raise ValueError(f"line {bad[0].line}: {bad[0].error}")
    if not spec.empty and rows.isEmpty():
        raise ValueError("no rows")
    return rows.drop("file", "error")
