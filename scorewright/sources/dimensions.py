"""Reference data: the weakness list, probe manifests and fixture suites, from TOML on the driver to small tables.

Their sizes are those of the published lists, tens of rows; tables made here may be broadcast.
"""

from __future__ import annotations

import tomllib
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from scorewright.functions.ids import PATTERNS
from scorewright.functions.paths import path_problem, placeholders
from scorewright.sources.records import FIXTURE, GROUNDS, SHAPES
from scorewright.sources.shapes import Flag, Items, Malformed, Number, Record, Table, Text

# The words of the lists.
EVIDENCE = {
    "reproduction": "a submission the grader paid for, re-created by a standalone reproduction script",
    "differentiating-input": "an input on which the submission and the reference produce different outputs",
    "differentiating-observation": "a read-only check of the end state, tied to a sentence of the task, that the reference and presumed-correct solutions pass and the submission fails",
    "fact": "a fact read from version history, such as a deleted test or an added exit call",
    "statistic": "a measurement over many tasks or runs, reported with its interval",
    "positive-control": "a certified-correct submission the grader rejected",
    "structural-risk": "a risk read from the harness without a working exploit, reported as suspected",
}
PROVIDES = {"template": "a template that generates the attack or the control", "fact": "a fact rule read from version history", "statistic": "a statistic in the scoring"}
EXPECT = ("reject", "accept", "consistent")
SOLUTIONS = ("no-op", "reference", "reference-emptied", "reference-constant", "reference-raising", "reference-exiting", "reference-spoofed", "reference-rewritten")
MATURITIES = ("experimental", "stable", "deprecated")

WORDS, HTTPS = Text(least="words"), Text("https://.*")
_SHAPES = Items(Text(among=SHAPES), least=1)
WEAKNESS = Record(
    {"id": Text(PATTERNS["weakness"]), "name": WORDS, "family": WORDS, "mechanism": WORDS, "shapes": _SHAPES, "grounds": Items(Text(among=GROUNDS)), "evidence": Items(Text(among=tuple(EVIDENCE)), least=1), "provides": Items(Text(among=tuple(PROVIDES))), "fix": WORDS, "sources": Items(HTTPS, least=1)},
    {"status": Text(among=("active", "deprecated"))},
    open=True,
)
LIST = Record(
    {"version": Number(whole=True, least=1), "families": Table(Text(), Text(), least=1)},
    {"weakness": Items(WEAKNESS), "crosswalk": Table(Text(), Record({"title": WORDS, "source": WORDS, "map": Table(Text(), Items(Text()), least=1)}, open=True))},
    open=True,
)
RULE = Record({"weakness": WORDS, "when_rejected": Text(PATTERNS["probe"]), "reason": WORDS})
TEMPLATE = Record({"solution": Text(among=SOLUTIONS)}, {"files": Table(Text(), Text()), "parameters": Items(Text("[A-Za-z_][A-Za-z0-9_]*"), once=True), "commands": Items(Text())}, open=True)
PROBE = Record(
    {"id": Text(PATTERNS["probe"]), "operator": WORDS, "weakness": Items(Text(), least=1), "title": WORDS, "shapes": _SHAPES, "expect": Text(among=EXPECT), "maturity": Text(among=MATURITIES), "battery": Number(whole=True, least=1), "template": TEMPLATE, "sources": Items(HTTPS, least=1)},
    {"ground": Text(among=GROUNDS), "guards": Items(Text()), "attribution": Items(RULE)},
    (
        (lambda p: (p["expect"] == "reject") == ("ground" in p), "a negative control has a ground, and nothing else does"),
        (lambda p: all(r["weakness"] in p["weakness"][1:] for r in p.get("attribution", [])), "an attribution to none of its later weaknesses"),
    ),
    open=True,
)
SUITE = Record(
    {"suite": Record({"level": Text(PATTERNS["level"]), "version": Number(whole=True, least=1)}, open=True), "fixture": Items(Record({"id": Text(FIXTURE), "weakness": Text(PATTERNS["weakness"]), "shape": Text(among=SHAPES), "defect": Flag()}, open=True), least=1)},
    rules=((lambda s: len({f["id"] for f in s["fixture"]}) == len(s["fixture"]), "a fixture is listed twice"),),
    open=True,
)


def toml(text: str, shape: Any, at: str) -> dict:
    try:
        data = tomllib.loads(text)
    except (tomllib.TOMLDecodeError, RecursionError) as x:
        raise Malformed(f"{at}: not TOML") from x
    shape.check(data, at)
    return data


def number(weakness: str) -> int:
    return int(weakness.rpartition("-")[2])


def twice(values: list[str]) -> set[str]:
    return {v for v in values if values.count(v) > 1}


def weakness_list(text: str) -> dict:
    """The list, its classes by number; families and crosswalks may only name what the list has."""
    data = toml(text, LIST, "weakness list")
    data["weakness"] = sorted(data.get("weakness", []), key=lambda w: number(w["id"]))
    known = [w["id"] for w in data["weakness"]]
    if again := twice(known):
        raise Malformed(f"listed twice: {sorted(again)}")
    for w in data["weakness"]:
        if w["family"] not in data["families"]:
            raise Malformed(f"{w['id']}: no such family")
    for name, c in data.get("crosswalk", {}).items():
        if lost := {i for ids in c["map"].values() for i in ids} - set(known):
            raise Malformed(f"crosswalk {name}: unknown {sorted(lost)}")
    return data


def weaknesses(spark: SparkSession, text: str) -> DataFrame:
    rows = [(w["id"], number(w["id"]), w["name"], w["family"], w["shapes"], w["grounds"], w["evidence"], w["provides"], w.get("status", "active"), w["fix"], w["sources"]) for w in weakness_list(text)["weakness"]]
    return spark.createDataFrame(rows, "id string, number int, name string, family string, shapes array<string>, grounds array<string>, evidence array<string>, provides array<string>, status string, fix string, sources array<string>")


def crosswalks(spark: SparkSession, text: str) -> DataFrame:
    rows = [(name, category, ids) for name, c in weakness_list(text).get("crosswalk", {}).items() for category, ids in c["map"].items()]
    return spark.createDataFrame(rows, "crosswalk string, category string, weakness array<string>")


def manifests(text: str, known: set[str]) -> list[dict]:
    """Probe manifests by id, checked against the weakness list and each other."""
    data = toml(text, Record({}, {"probe": Items(PROBE)}, open=True), "manifests").get("probe", [])
    for key in ("id", "operator"):
        if again := twice([p[key] for p in data]):
            raise Malformed(f"{key} twice: {sorted(again)}")
    ids = {p["id"] for p in data}
    for p in data:
        if not set(p["weakness"]) <= known:
            raise Malformed(f"{p['id']}: a weakness that the list does not have")
        for r in p.get("attribution", []):
            if r["when_rejected"] not in ids - {p["id"]}:
                raise Malformed(f"{p['id']}: attribution by a probe that is not among the others")
        t = p["template"]
        own = set(t.get("parameters", []))
        for path in t.get("files", {}):
            if wrong := path_problem(path, own):
                raise Malformed(f"{p['id']}: {path!r} {wrong}")
        if lost := {x for c in t.get("commands", []) for x in placeholders(c)} - own:
            raise Malformed(f"{p['id']}: a command names undeclared {sorted(lost)}")
    return sorted(data, key=lambda p: p["id"])


def probes(spark: SparkSession, text: str, known: set[str]) -> DataFrame:
    """One row a probe; rules is what operators.evidence.attribute takes."""
    rows = [
        (p["id"], p["operator"], p["weakness"], p["title"], p["shapes"], p.get("ground"), p["expect"], p["maturity"], p["battery"], p["template"]["solution"], [(r["weakness"], r["when_rejected"]) for r in p.get("attribution", [])])
        for p in manifests(text, known)
    ]
    return spark.createDataFrame(rows, "probe string, operator string, weakness array<string>, title string, shapes array<string>, ground string, expect string, maturity string, battery int, solution string, rules array<struct<weakness:string,when_rejected:string>>")


def fixtures(spark: SparkSession, text: str, level: str | None = None) -> DataFrame:
    """id, weakness, shape, defect of a suite; another level than the one asked for is a KeyError."""
    data = toml(text, SUITE, "suite")
    if level is not None and data["suite"]["level"] != level:
        raise KeyError(level)
    return spark.createDataFrame([(f["id"], f["weakness"], f["shape"], f["defect"]) for f in data["fixture"]], "id string, weakness string, shape string, defect boolean")


def weakness_markdown(text: str) -> str:
    """The list as a page: families with their classes, then the crosswalks."""
    data = weakness_list(text)
    out = ["# Weakness list", "", f"Version **{data['version']}**.", "", *(f"- **{k}**: {v}" for k, v in PROVIDES.items()), "", "Evidence kinds:", "", *(f"- **{k}**: {v}" for k, v in EVIDENCE.items()), ""]
    for family, title in data["families"].items():
        own = [w for w in data["weakness"] if w["family"] == family]
        if not own:
            continue
        out += [f"## {title}", "", "| ID | Weakness | Shapes | Provides |", "|---|---|---|---|"]
        out += [f"| [{w['id']}](#{w['id'].lower()}) | {w['name']} | {', '.join(w['shapes'])} | {', '.join(w['provides']) or 'definition'} |" for w in own]
        for w in own:
            old = " (deprecated)" if w.get("status") == "deprecated" else ""
            out += ["", f"### {w['id']}", "", f"**{w['name']}**{old}. {w['mechanism']}", "", f"- **Evidence:** {', '.join(w['evidence'])}", f"- **Grounds:** {', '.join(w['grounds']) or 'none'}", f"- **Fix:** {w['fix']}", f"- **Sources:** {' · '.join(f'<{s}>' for s in w['sources'])}"]
        out.append("")
    out += ["## Crosswalks", ""]
    for c in data.get("crosswalk", {}).values():
        out += [f"### {c['title']}", "", f"Source: <{c['source']}>", "", "| Category | Classes |", "|---|---|", *(f"| {k} | {', '.join(v) or 'none (not a grader weakness)'} |" for k, v in c["map"].items()), ""]
    return "\n".join(out)
