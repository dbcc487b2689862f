"""Small documents: decisions and conformance results."""

from __future__ import annotations

import datetime as dt
import json
import re
import tomllib

from pyspark.sql import DataFrame, SparkSession

from scorewright.functions.ids import PATTERNS
from scorewright.sources.records import conformance
from scorewright.sources.shapes import parse


def toml(text: str) -> dict:
    try:
        return tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError) as x:
        raise ValueError("not TOML") from x


def decisions(spark: SparkSession, text: str) -> DataFrame:
    """finding, action, reason, decided, expires of a decisions file; one for a finding, expiry after the day decided."""
    data, rows, seen = toml(text), [], set()
    if data.get("version") != 1 or set(data) - {"version", "decision"}:
        raise ValueError("not a decisions file of version 1")
    for d in data.get("decision", []):
        day = lambda k: d.get(k) if type(d.get(k)) in (dt.date, type(None)) else None  # noqa: B023, E731
        if not re.fullmatch(PATTERNS["finding"], str(d.get("finding"))) or d.get("action") not in ("ignore", "dispute") or not str(d.get("reason", "")).strip() or day("decided") is None or set(d) - {"finding", "action", "reason", "decided", "expires"}:
            raise ValueError(f"a malformed decision on {d.get('finding')!r}")
        if ("expires" in d and (day("expires") is None or d["expires"] <= d["decided"])) or d["finding"] in seen:
            raise ValueError(f"{d['finding']}: decided twice, or expired before it was decided")
        seen.add(d["finding"])
        rows.append((d["finding"], d["action"], d["reason"], d["decided"], d.get("expires")))
    return spark.createDataFrame(rows, "finding string, action string, reason string, decided date, expires date")


def format_decisions(rows: list) -> str:
    """A decisions file, by finding, that reads back to the same rows."""
    out = ["version = 1\n"]
    for r in sorted(rows, key=lambda r: r.finding):
        out.append(f"\n[[decision]]\nfinding = {json.dumps(r.finding)}\naction = {json.dumps(r.action)}\nreason = {json.dumps(r.reason).replace(chr(127), chr(92) + 'u007f')}\ndecided = {r.decided}\n" + (f"expires = {r.expires}\n" if r.expires else ""))
    return "".join(out)


def conformance_results(spark: SparkSession, text: str, base: str | None = None) -> DataFrame:
    """fixture, status, flagged, level, version, tool, tool_version of a results document."""
    data = parse(text)
    conformance(base).check(data, "results")
    head = (data["suite"]["level"], data["suite"]["version"], data["tool"]["name"], data["tool"]["version"])
    rows = [(r["fixture"], r["status"], r.get("flagged"), *head) for r in data["results"]]
    return spark.createDataFrame(rows, "fixture string, status string, flagged array<string>, level string, version int, tool string, tool_version string")
