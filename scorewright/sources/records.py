"""Findings, registry records, reproduction results and scripts, read strictly, one document a line or a file.

A document's shape and the rules that go beyond it are data (shapes.Record); one reader serves all. The sound documents'
columns and every unsound one's problem come out of one Python stage; nothing is gathered on the driver.
"""

from __future__ import annotations

import ast
import datetime as dt
import json
import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions.ids import PATTERNS
from scorewright.functions.share import dealt_evenly
from scorewright.sources.shapes import Either, Flag, Items, Malformed, Number, Record, Table, Text, parse, problem

# The words of the formats.
LEVELS = ("proven", "proven-experimental", "suspected", "lead", "observation", "excluded")
PROVEN = ("proven", "proven-experimental")
GROUNDS = ("structural", "differential", "invariant")
SHAPES = ("program", "io", "workspace", "container", "history", "numeric", "proof", "query")
STATUSES = ("reported", "confirmed", "fixed", "disputed", "withdrawn")
ARTIFACTS = ("environment", "benchmark", "grader", "harness")
RANGES = ("GIT", "SEMVER", "ECOSYSTEM")
EVENTS = ("introduced", "fixed", "last_affected", "limit")
REFERENCES = ("ADVISORY", "ARTICLE", "DETECTION", "DISCUSSION", "REPORT", "FIX", "INTRODUCED", "GIT", "PACKAGE", "EVIDENCE", "WEB")
CREDITS = ("FINDER", "REPORTER", "ANALYST", "COORDINATOR", "REMEDIATION_DEVELOPER", "REMEDIATION_REVIEWER", "REMEDIATION_VERIFIER", "TOOL", "SPONSOR", "OTHER")
NETWORK = {"ftplib", "http", "httpx", "requests", "smtplib", "socket", "ssl", "urllib", "urllib3", "webbrowser"}
EXITS = {"reproduced": 0, "not-reproduced": 1, "flaky": 2, "baseline-failed": 3, "error": 4}
FIXTURE = "bcl-[1-4]/[a-z0-9]+(?:-[a-z0-9]+)*/(?:correct|defect)"
LEAST_RUNS, LEAST_CORRECT, NOTICE_DAYS = 3, 3, 45

DIGEST = Text("sha256:[0-9a-f]{64}")
SOME, WORDS, URL = Text(least="some"), Text(least="words"), Text("https?://.*")
SUBMISSION = Either((
    Record({"kind": Text(among=("source",)), "sha256": DIGEST}),
    Record({"kind": Text(among=("workspace",)), "files": Table(SOME, DIGEST, nullable=True), "commands": Items(Text()), "parameters": Items(Text("[A-Za-z_][A-Za-z0-9_]*"))}),
))
SCORED = Record({"reward": Number(), "passed": Flag()})
SCRIPT = Record({"script": SOME, "sha256": DIGEST})
INPUT = Record({"input": Text(), "reference_output": Text(), "submission_output": Text()}, rules=((lambda d: d["reference_output"] != d["submission_output"], "both outputs are one"),))
OBSERVATION = Record({"requirement": WORDS, "observation": WORDS, "reference_passed": Flag(), "presumed_correct_passed": Items(Flag()), "submission_passed": Flag()})
RUN = Record({"tool": SOME, "tool_version": SOME}, {"environment_digest": Text(), "conditions": Table(Text(), Either((Flag(), Text(), Number()))), "provenance": Text()})


def observation_proves(o: dict) -> bool:
    """Never too narrow, as enough work that is presumed correct passes it, and failed by the submission."""
    return o["reference_passed"] and len(o["presumed_correct_passed"]) >= LEAST_CORRECT and all(o["presumed_correct_passed"]) and not o["submission_passed"]


def if_proven(test: Callable[[dict], bool]) -> Callable[[dict], bool]:
    return lambda f: f["level"] not in PROVEN or test(f)


def address(base: str | None, name: str) -> Text:
    """A schema's address: below base, or below any address where none is given."""
    return Text(rf"https?://\S+/{name}/v1") if base is None else Text(among=(f"{base}/{name}/v1",))


def finding(base: str | None) -> Record:
    """The shape of a finding under schema addresses that begin with base."""
    watched = lambda f: f.get("differentiating_observation")
    return Record(
        {"$schema": address(base, "finding"), "id": Text(PATTERNS["finding"]), "weakness": Text(PATTERNS["weakness"]), "probe": Text(PATTERNS["probe"]), "level": Text(among=LEVELS),
         "task": Record({"id": SOME, "shape": Text(among=SHAPES)}), "battery": Number(whole=True, least=1)},
        {"submission": SUBMISSION, "ground": Text(among=GROUNDS), "verdict": SCORED, "baseline": Record({"passed": Flag()}), "reproduce": SCRIPT, "differentiating_input": INPUT,
         "differentiating_observation": OBSERVATION, "run": RUN, "fix": Text(), "reason": Text()},
        (
            (if_proven(lambda f: {"submission", "ground", "verdict", "reproduce"} <= set(f)), "proven without a submission, its ground, a verdict and a script"),
            (if_proven(lambda f: f["verdict"]["passed"]), "proven by a grader that did not pay"),
            (if_proven(lambda f: f.get("baseline", {}).get("passed", False)), "proven without a baseline that passed"),
            (if_proven(lambda f: f["ground"] != "differential" or "differentiating_input" in f or "differentiating_observation" in f), "a differential ground without its input or observation"),
            (if_proven(lambda f: not watched(f) or observation_proves(watched(f))), "the observation proves nothing"),
            (if_proven(lambda f: not watched(f) or f["level"] == "proven-experimental"), "an observation proves at the experimental level only"),
            (lambda f: f["level"] not in ("lead", "excluded") or bool(f.get("reason", "").strip()), "a lead or an exclusion without its reason"),
        ),
    )


STAMP = r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]+)?Z"


class Moment:
    """A real date and time in UTC."""

    def check(self, v: Any, at: str) -> None:
        Text(STAMP).check(v, at)
        try:
            dt.datetime.fromisoformat(v)
        except ValueError as x:
            raise Malformed(f"{at}: no real time") from x


class Event:
    def check(self, v: Any, at: str) -> None:
        Table(Text(among=EVENTS), SOME, least=1).check(v, at)
        if len(v) != 1:
            raise Malformed(f"{at}: more than one event")


def notice_kept(r: dict) -> bool:
    told, out = (dt.datetime.fromisoformat(x) for x in (r["disclosure"]["maintainer_notified"], r["published"]))
    early = r["status"] == "fixed" and r["disclosure"].get("maintainer_agreed_early", False)
    return out >= told and (early or out >= told + dt.timedelta(days=NOTICE_DAYS))


def registry(base: str | None, known: set[str]) -> Record:
    """The shape of a registry record that names only the known weaknesses."""
    span = Record({"type": Text(among=RANGES), "events": Items(Event(), least=1)}, {"repo": URL}, ((lambda r: r["type"] != "GIT" or "repo" in r, "a range of commits without its repository"),))
    artifact = Record({"kind": Text(among=ARTIFACTS), "name": SOME}, {"repository": URL})
    affected = Record({"artifact": artifact, "shape": Text(among=SHAPES)}, {"ranges": Items(span, least=1), "versions": Items(SOME, once=True)})
    return Record(
        {"$schema": address(base, "registry-record"), "schema_version": Text(r"1\.[0-9]+\.[0-9]+"), "id": Text(PATTERNS["record"]), "modified": Moment(), "published": Moment(), "summary": Text(least="some", longest=120),
         "weakness": Items(Text(PATTERNS["weakness"]), least=1, once=True), "affected": Items(affected, least=1), "status": Text(among=STATUSES), "numbering_authority": SOME,
         "disclosure": Record({"maintainer_notified": Moment()}, {"maintainer_agreed_early": Flag()})},
        {"aliases": Items(SOME, once=True), "related": Items(SOME, once=True), "withdrawn": Moment(), "details": SOME, "probe": Text(PATTERNS["probe"]), "findings": Items(Text(PATTERNS["finding"]), once=True), "submission": SUBMISSION,
         "score_received": SCORED, "ground": Text(among=GROUNDS), "reproduce": SCRIPT, "references": Items(Record({"type": Text(among=REFERENCES), "url": URL})), "credits": Items(Record({"name": SOME}, {"contact": Items(SOME), "type": Text(among=CREDITS)}))},
        (
            (lambda r: (r["status"] == "withdrawn") == ("withdrawn" in r), "withdrawn says when, and nothing else does"),
            (lambda r: set(r["weakness"]) <= known, "a weakness that the list does not have"),
            (notice_kept, "published before its notice has passed"),
        ),
    )


def judged(runs: list[dict], baseline: list[dict], error: str) -> str:
    """What the runs of a reproduction show."""
    base, own = ({r["passed"] for r in x} for x in (baseline, runs))
    if error or min(len(runs), len(baseline)) < LEAST_RUNS:
        return "error"
    if base == {False}:
        return "baseline-failed"
    if max(len(base), len(own)) > 1:
        return "flaky"
    return "reproduced" if own == {True} else "not-reproduced"


def reproduction_result(base: str | None) -> Record:
    shows = lambda r: judged(r["runs"], r["baseline_runs"], r.get("error", ""))
    return Record(
        {"$schema": address(base, "reproduction-result"), "finding": Text(PATTERNS["finding"]), "submission": SUBMISSION, "runs": Items(SCORED), "baseline_runs": Items(SCORED), "outcome": Text(among=tuple(EXITS))},
        {"python": Text(), "platform": Text(), "error": Text()},
        ((lambda r: shows(r) != "error" or bool(r.get("error", "").strip()), "an error that says nothing"), (lambda r: r["outcome"] == shows(r), "its outcome is not what its runs show")),
    )


def read_reproduction(stdout: str, exit_code: int, base: str | None) -> dict:
    """The report on the last line that holds something, where its exit code agrees too."""
    lines = [x for x in stdout.splitlines() if x.strip()]
    if not lines:
        raise Malformed("nothing was printed")
    r = parse(lines[-1])
    reproduction_result(base).check(r, "result")
    if exit_code != EXITS[r["outcome"]]:
        raise Malformed(f"exit code {exit_code} with the outcome {r['outcome']}")
    return r


def conformance(base: str | None) -> Record:
    one = Record(
        {"fixture": Text(FIXTURE), "status": Text(among=("ran", "error", "skipped"))},
        {"flagged": Items(Text(PATTERNS["weakness"]), once=True), "message": SOME},
        ((lambda r: (r["status"] == "ran") == ("flagged" in r), "flagged goes with a fixture that ran"),),
    )
    return Record(
        {"$schema": address(base, "conformance-results"), "suite": Record({"level": Text(PATTERNS["level"]), "version": Number(whole=True, least=1)}), "tool": Record({"name": SOME, "version": SOME}), "results": Items(one)},
        rules=((lambda d: len({r["fixture"] for r in d["results"]}) == len(d["results"]), "a fixture is reported twice"),),
    )


def documents(spark: SparkSession, path: str, whole: bool) -> DataFrame:
    """(file, line, text): whole files, or the lines of JSON Lines files that hold something."""
    from scorewright.sources.strict import numbered_lines

    if whole:
        return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.lit(1).cast("long").alias("line"), F.col("value").alias("text"))
    return numbered_lines(spark, path).where(F.trim("text") != "")


def read(texts: DataFrame, shape: Record, columns: str, pick: Callable[[dict], tuple]) -> DataFrame:
    """(file, line, error, columns) of texts(file, line, text); error is null where the document is sound, and pick names its columns."""
    names = [c.strip().split(" ")[0] for c in columns.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for file, line, text in b[["file", "line", "text"]].itertuples(index=False):
                try:
                    v = parse(text)
                    wrong = problem(shape, v)
                except Malformed as x:
                    wrong = str(x)
                rows.append((file, line, wrong, *((None,) * len(names) if wrong else pick(v))))
            yield pd.DataFrame(rows, columns=["file", "line", "error", *names]).astype(object)

    return dealt_evenly(texts.select("file", "line", "text")).mapInPandas(run, f"file string, line long, error string, {columns}")


FINDING = "id string, weakness string, probe string, level string, task_id string, shape string, battery long, ground string, passed boolean, baseline_passed boolean, submission string, reason string, record string"


def findings(texts: DataFrame, base: str | None) -> DataFrame:
    def pick(f: dict) -> tuple:
        text = lambda k: json.dumps(f[k], sort_keys=True) if k in f else None
        return (f["id"], f["weakness"], f["probe"], f["level"], f["task"]["id"], f["task"]["shape"], f["battery"], f.get("ground"), f.get("verdict", {}).get("passed"), f.get("baseline", {}).get("passed"), text("submission"), f.get("reason"), json.dumps(f))

    return read(texts, finding(base), FINDING, pick)


RECORD = "id string, status string, published string, modified string, notified string, summary string, weakness array<string>, affected array<struct<name:string,shape:string>>"


def registry_records(texts: DataFrame, base: str | None, known: set[str]) -> DataFrame:
    def pick(r: dict) -> tuple:
        return (r["id"], r["status"], r["published"], r["modified"], r["disclosure"]["maintainer_notified"], r["summary"], r["weakness"], [{"name": a["artifact"]["name"], "shape": a["shape"]} for a in r["affected"]])

    return read(texts, registry(base, known), RECORD, pick)


def finding_json() -> str:
    """SQL: a finding's columns as its record, evidence that is null left out."""
    return (
        "to_json(named_struct('$schema', schema, 'id', id, 'weakness', weakness, 'probe', probe, 'level', level, 'task', named_struct('id', task_id, 'shape', shape), 'battery', battery, 'ground', ground,"
        " 'verdict', CASE WHEN passed IS NOT NULL THEN named_struct('reward', reward, 'passed', passed) END, 'baseline', CASE WHEN baseline_passed IS NOT NULL THEN named_struct('passed', baseline_passed) END,"
        " 'reason', nullif(reason, '')), map('ignoreNullFields', 'true'))"
    )


def script_metadata(text: str) -> dict:
    """The one inline metadata block of a script."""
    import tomllib

    blocks, inside = [], None
    for line in text.splitlines():
        if inside is None and re.fullmatch(r"# /// script\s*", line):
            inside = []
        elif inside is not None and line.rstrip() == "# ///":
            blocks.append("\n".join(inside))
            inside = None
        elif inside is not None and (line == "#" or line.startswith("# ")):
            inside.append(line[2:])
        else:
            inside = None
    if len(blocks) != 1:
        raise Malformed(f"{len(blocks)} metadata blocks instead of one")
    try:
        return tomllib.loads(blocks[0])
    except (tomllib.TOMLDecodeError, RecursionError) as x:
        raise Malformed("its metadata block is not TOML") from x


def script_problems(text: str, finding_: dict, base: str, tool: str) -> list[str]:
    """What is wrong with a reproduction script of a finding, read without running it; tool names the table that it declares
    itself in and the package that it must do without."""
    try:
        meta = script_metadata(text)
    except Malformed as x:
        return [f"metadata: {x}"]
    own = meta.get("tool", {}).get(tool, {})
    sent = own.get("submission")
    if isinstance(sent, dict) and sent.get("kind") == "workspace":  # TOML has no null: deleted files stand in a list
        sent = {k: v for k, v in sent.items() if k != "deleted"} | {"files": dict(sent.get("files", {})) | dict.fromkeys(sent.get("deleted", []))}
    runs = own.get("runs")
    out = [
        said
        for bad, said in (
            ("requires-python" not in meta, "metadata: no requires-python"),
            (own.get("schema") != f"{base}/reproduction/v1", "another schema"),
            (own.get("finding") != finding_["id"], "another finding"),
            (own.get("probe") != finding_["probe"], "another probe"),
            ("submission" not in finding_ or sent != finding_["submission"], "another submission"),
            (isinstance(runs, bool) or not isinstance(runs, int) or runs < LEAST_RUNS, f"fewer than {LEAST_RUNS} runs"),
        )
        if bad
    ]
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return [*out, "not Python"]
    names = [a.name for n in ast.walk(tree) if isinstance(n, ast.Import) for a in n.names] + [n.module for n in ast.walk(tree) if isinstance(n, ast.ImportFrom) and n.module and not n.level]
    used = {n.partition(".")[0] for n in names}
    return out + [
        said
        for bad, said in (
            (tool in used, f"imports {tool}"),
            (bool(used & NETWORK), "imports the network"),
            (not used & {"subprocess", "multiprocessing"}, "starts no process"),
            (f"{base}/reproduction-result/v1" not in text, "reports no result"),
        )
        if bad
    ]
