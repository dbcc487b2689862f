"""Queries over changes, tasks and records that expressions make from the tables, with the expected rows as SQL.

Syntax and strict JSON have no SQL, so each case is written out with what must come of it, and every row of a table takes one.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions.paths import path_fault
from scorewright.operators import battery, change_facts, evidence, power
from scorewright.sources import records, strict
from scorewright.streaming.running import running_scores

from .queries import _models, duck, query, rounded
from .views import view, views

T = "def test_x():\n    assert f(1) == 2\n    assert g() == 3\n"
A, M = "tests/test_a.py", "src/m.py"
#: (path, before, after, [(rule, subject, line)]) of a change, and what it says.
CHANGES = [
    (A, T + "\ndef test_y():\n    assert h() == 1\n", T, [("tests-removed", "", None)]),
    (A, T, "import pytest\n@pytest.mark.skip\n" + T, [("skips-added", "", 2)]),
    (A, T, "import pytest\n@pytest.mark.skipif(1, reason='')\n" + T, [("conditional-skips-added", "", 2)]),
    (A, T, T + "    assert True\n", [("trivial-checks-added", "", 4)]),
    (A, T, T + "\ndef test_new():\n    pass\n", [("tests-without-checks", "", 5)]),
    ("tests/conftest.py", "", "def pytest_runtest_makereport(item):\n    pass\n", [("report-hook-added", "", 1)]),
    (A, T, "def test_x():\n    assert f(1)\n    assert g()\n", [("check-weakened", "test_x", 1)]),
    (A, "def test_x():\n    assert f() == approx(1)\n", "def test_x():\n    assert f() == approx(1, rel=0.1)\n", [("tolerance-loosened", "test_x", 1)]),
    (A, "@pytest.mark.timeout(1)\n" + T, "@pytest.mark.timeout(9)\n" + T, [("timeout-raised", "test_x", 2)]),
    (A, T, T.replace("== 3", "== 4"), [("expected-value-changed", "test_x", 1)]),
    (A, T, "def test_x():\n    try:\n        assert f(1) == 2\n        assert g() == 3\n    except AssertionError:\n        pass\n", [("failure-swallowed", "test_x", 1)]),
    (A, "def test_parse():\n    assert parse() == 1\n", "def test_parse():\n    patch('m.parse')\n    assert parse() == 1\n", [("subject-mocked", "test_parse", 1)]),
    (A, T, "def test_x():\n    assert f(1) == 2\n", [("checks-removed", "", 1)]),
    (M, "x = 1\n", "import time\ntime.time = lambda: 0\n", [("timer-reassigned", "", 2)]),
    (M, "x = 1\n", "import sys\nsys.exit(0)\n", [("exit-added", "", 2)]),
    (M, "x = 1\n", "class A:\n    def __eq__(self, o):\n        return True\n", [("always-equal-added", "", 2)]),
    (M, "def f(x):\n    return x + 1\n", "def f(x):\n    ...\n", [("replaced-by-stub", "", 1)]),
    ("pytest.ini", "[pytest]\naddopts = -q\n", "[pytest]\naddopts = -k one\n", [("selection-changed", "addopts", 1)]),
    # Honest changes, of which nothing may be said.
    (A, T, T.replace("f(1)", "f(1, 2)"), []),
    (A, T, "# a comment\n" + T + "\n\ndef test_more():\n    assert h() == 5\n", []),
    (M, "def f(x):\n    return x + 1\n", "def f(x):\n    return x + 2\n", []),
    ("README.md", "def test_x():\n    pass\n", None, []),
    (A, "def (", T, []),
]
WEAKNESS = {"report-hook-added": 108, "tolerance-loosened": 134, "timer-reassigned": 113, "exit-added": 102, "always-equal-added": 103, "replaced-by-stub": 101}
SOFT = ("conditional-skips-added", "trivial-checks-added", "tests-without-checks", "expected-value-changed", "subject-mocked", "exit-added")


def lit(v) -> str:
    return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"


def table(rows: list[tuple], columns: str) -> str:
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns})"


def dealt(spark: SparkSession, sf_dir: str, source: str, key: str, cases: list[tuple], columns: str) -> DataFrame:
    """Every row of a table with one of the cases, in turn; the cases are a few rows."""
    small = spark.createDataFrame([(k, *c) for k, c in enumerate(cases)], f"k int, {columns}")
    return spark.read.parquet(f"{sf_dir}/{source}.parquet").select(F.col(key).alias("row")).join(F.broadcast(small), F.col("row") % len(cases) == F.col("k"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = dealt(spark, sf_dir, "part", "p_partkey", [c[:3] for c in CHANGES], "path string, before string, after string")
    note = lambda c: F.when(F.col(c).isNotNull() & (F.col(c) != ""), F.concat(c, F.lit("# "), F.col("row").cast("string"), F.lit("\n"))).otherwise(F.col(c))
    return at.select(F.col("row").cast("string").alias("change"), "path", note("before").alias("before"), note("after").alias("after"))


_FACTS = [(k, c[0], rule, f"BGW-{WEAKNESS.get(rule, 109)}", "observation" if rule in SOFT else "fact", subject, line) for k, c in enumerate(CHANGES) for rule, subject, line in c[3]]
_N = len(CHANGES)


@query("change_facts", f"SELECT CAST(p_partkey AS VARCHAR) AS change, path, rule, weakness, kind, subject, line FROM part JOIN {table(_FACTS, 'k, path, rule, weakness, kind, subject, line')} ON p_partkey % {_N} = k")
def facts_query(spark, sf_dir):
    return change_facts.change_facts(changes(spark, sf_dir)).select("change", "path", "rule", "weakness", "kind", "subject", "line")


@query("change_not_checked", f"SELECT CAST(p_partkey AS VARCHAR) AS change, '{A}' AS path FROM part WHERE p_partkey % {_N} = {_N - 1}")
def not_checked_query(spark, sf_dir):
    return change_facts.not_checked(change_facts.file_features(changes(spark, sf_dir)))


_NEW = {0: "x", 1: "x", 2: "x", 3: "x", 4: "x new", 6: "x", 7: "x", 8: "x", 9: "x", 10: "x", 11: "parse", 12: "x", 18: "x", 19: "x more"}
_MATCH = [(k, f"test_{n}", None if n in ("new", "more") else f"test_{n}") for k, ns in _NEW.items() for n in ns.split()]


@query("change_test_matches", f"SELECT CAST(p_partkey AS VARCHAR) AS change, '{A}' AS path, new, old FROM part JOIN {table(_MATCH, 'k, new, old')} ON p_partkey % {_N} = k")
def matches_query(spark, sf_dir):
    m = change_facts.test_matches(change_facts.file_features(changes(spark, sf_dir)))
    return m.select("change", "path", F.col("new.name").alias("new"), F.col("old.name").alias("old"))


@query("change_fingerprints", f"SELECT CAST(p_partkey AS VARCHAR) AS change, CASE kind WHEN 'fact' THEN 'warning' ELSE 'note' END AS level, coalesce(line, 1)::INT AS start, left(sha256(rule || chr(0) || path || chr(0) || subject), 32) AS fingerprint FROM part JOIN {table(_FACTS, 'k, path, rule, weakness, kind, subject, line')} ON p_partkey % {_N} = k")
def sarif_query(spark, sf_dir):
    results = change_facts.to_sarif(change_facts.change_facts(changes(spark, sf_dir)))
    get = lambda p: F.get_json_object("result", p)
    return results.select("change", get("$.level").alias("level"), get("$.locations[0].physicalLocation.region.startLine").cast("int").alias("start"), get("$.partialFingerprints['fact/v1']").alias("fingerprint"))


SOLVE = "def solve(items):\n    total = 0\n    for x in items:\n        if x > 0:\n            total += x\n    return total\n"
HOLLOW = ["constant_implementation", "drop_side_effect", "equality_spoofing", "raise_not_implemented", "success_exit"]
BESIDE = {"workspace": ["parser_replaced", "test_framework_hook", "tests_deleted"], "container": ["hijacked_tool", "measurement_tampered", "parser_replaced", "reward_written", "test_framework_hook", "tests_deleted"], "history": ["measurement_tampered", "test_framework_hook", "tests_deleted"]}
#: (shape, reference, operators, those of them that are leads, controls) of a task.
TASKS = [
    ("program", SOLVE, HOLLOW, [], ["oracle", "renamed_locals"]),
    ("program", "def f(a):\n    total = a  # keep\n    return total\n", HOLLOW[1:], [], ["oracle", "comment_free", "renamed_locals"]),
    ("program", "class A:\n    def f(self): raise NotImplementedError\n", [], [], None),
    ("program", None, [], [], []),
    ("program", "70", [], [], ["oracle"]),
    ("io", SOLVE, [], [], ["oracle", "renamed_locals"]),
    *((shape, SOLVE, ops, [], ["oracle", "renamed_locals"]) for shape, ops in BESIDE.items()),
]


def tasks_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dealt(spark, sf_dir, "customer", "c_custkey", [t[:2] for t in TASKS], "shape string, reference string").select(F.col("row").cast("string").alias("task_id"), "shape", "reference")


_OPS = [(k, op, None if op in t[3] else "structural") for k, t in enumerate(TASKS) for op in t[2]]


@query("battery_candidates", f"SELECT CAST(c_custkey AS VARCHAR) AS task_id, operator, ground FROM customer JOIN {table(_OPS, 'k, operator, ground')} ON c_custkey % {len(TASKS)} = k")
def battery_query(spark, sf_dir):
    return battery.battery(tasks_of(spark, sf_dir)).select("task_id", "operator", "ground")


@query("battery_sizes", f"SELECT CAST(c_custkey AS VARCHAR) AS task_id, count(*)::BIGINT AS candidates, 0::BIGINT AS suppressed, 0::BIGINT AS withdrawn FROM customer JOIN {table(_OPS, 'k, operator, ground')} ON c_custkey % {len(TASKS)} = k GROUP BY c_custkey")
def sizes_query(spark, sf_dir):
    return battery.battery_counts(tasks_of(spark, sf_dir))


_CONTROLS = [(k, c) for k, t in enumerate(TASKS) if t[4] for c in t[4]]
_KNOWN = ", ".join(str(k) for k, t in enumerate(TASKS) if t[4] is not None)


@query("battery_controls", f"SELECT CAST(c_custkey AS VARCHAR) AS task_id, relation FROM customer JOIN {table(_CONTROLS, 'k, relation')} ON c_custkey % {len(TASKS)} = k")
def controls_query(spark, sf_dir):
    tasks = tasks_of(spark, sf_dir).where(F.coalesce("reference", F.lit("")) != TASKS[2][1])
    return battery.positive_controls(tasks).select("task_id", "relation")


PAIRS = [
    ("x", "x", "exact", False), (" x", "x", "whitespace", False), ("X", "x", "case", False), ("1", "1.00", "numeric", False), ("[]", "[ ]", "literal", False), ("yes", "TRUE", "boolean", False), ("[[0]]", "0", "singleton", False), ("a", "b", None, False),
    ("null", " null", "whitespace", False), ("[true]", "true", "singleton", False), ("x = 1  # c\n", "x = 1\n", None, True), ("x = 1", "x = 2", None, False),
]


@query("answer_collisions", f"SELECT p_partkey AS row, collides FROM part JOIN {table([(k, p[2]) for k, p in enumerate(PAIRS)], 'k, collides')} ON p_partkey % {len(PAIRS)} = k")
def collisions_query(spark, sf_dir):
    at = dealt(spark, sf_dir, "part", "p_partkey", [p[:2] for p in PAIRS], "left string, right string")
    return at.select("row", "left", "right").join(F.broadcast(battery.equivalence(at.select("left", "right").distinct())), ["left", "right"]).select("row", "collides")


# --- strict rows

ROWS = [
    ('{"task_id":"t","model":"m","score":1}', None), ('{"task_id":"t","model":"m","score":null,"other":[1]}', None), ('{"model":"m","score":1}', "task_id is missing"), ('{"task_id":"t","model":"m","score":true}', "score is not a number"),
    ('{"task_id":"","model":"m","score":1}', "task_id is empty"), ('{"task_id":"t","model":"m","score":1,"sample":-1}', "sample is below 0"), ('{"task_id":"t","model":"m","score":1,"max_score":0}', "max_score is not above 0"), ('{"task_id":"t","model":"m","score":1,"cluster":null}', "cluster is null"),
    ("[1]", "not an object"), ("nope", "not JSON"), ('{"task_id":"t","model":"m","score":1e999}', "score is not finite"),
]


@query("rows_validated", f"SELECT event_id AS line, error FROM events JOIN {table([(k, e) for k, (_, e) in enumerate(ROWS)], 'k, error')} ON event_id % {len(ROWS)} = k")
def rows_query(spark, sf_dir):
    at = dealt(spark, sf_dir, "events", "event_id", [r[:1] for r in ROWS], "text string")
    return strict.checked(at.select(F.lit("events").alias("file"), F.col("row").cast("long").alias("line"), "text"), strict.RESULTS).select("line", "error")


_OUT = '{"finding":"BF-0123456789","probe":"a/b@1","battery":2,"level":"proven","outcome":"stands","dismissed":false}'
FATES = [
    (strict.OUTCOMES, _OUT, None), (strict.OUTCOMES, _OUT.replace("stands", "withdrawn-after-dispute"), None), (strict.OUTCOMES, _OUT.replace("stands", "contradicted-by-fixture"), None), (strict.OUTCOMES, _OUT.replace("stands", "withdrawn"), "no"),
    (strict.OUTCOMES, _OUT.replace('"proven"', '"lead"'), "no"), (strict.OUTCOMES, _OUT.replace("2,", "0,"), "no"), (strict.OUTCOMES, _OUT.replace("}", ',"x":1}'), "no"), (strict.OUTCOMES, _OUT.replace("false", '"false"'), "no"),
]


@query("outcome_rows", f"SELECT event_id AS line, sound FROM events JOIN {table([(k, int(f[2] is None)) for k, f in enumerate(FATES)], 'k, s')} ON event_id % {len(FATES)} = k, LATERAL (SELECT s = 1 AS sound)")
def fates_query(spark, sf_dir):
    at = dealt(spark, sf_dir, "events", "event_id", [f[1:2] for f in FATES], "text string")
    rows = strict.checked(at.select(F.lit("events").alias("file"), F.col("row").cast("long").alias("line"), "text"), strict.OUTCOMES)
    return rows.select("line", F.col("error").isNull().alias("sound"))


_PLANT = {"weakness": "BGW-7", "instance": "i", "tried": True, "accepted": True, "proven": False}
PLANTS = [(_PLANT, 1), (_PLANT | {"method": "m"}, 1), (_PLANT | {"tried": False}, 0), (_PLANT | {"accepted": False, "proven": True}, 0), (_PLANT | {"weakness": "BGW-07"}, 0), (_PLANT | {"extra": 1}, 0)]


@query("planted_rows", f"SELECT p_partkey AS line, sound FROM part JOIN {table([(k, s) for k, (_, s) in enumerate(PLANTS)], 'k, s')} ON p_partkey % {len(PLANTS)} = k, LATERAL (SELECT s = 1 AS sound)")
def planted_query(spark, sf_dir):
    at = dealt(spark, sf_dir, "part", "p_partkey", [(json.dumps(p),) for p, _ in PLANTS], "text string")
    rows = strict.checked(at.select(F.lit("part").alias("file"), F.col("row").cast("long").alias("line"), "text"), strict.PLANTED)
    return rows.select("line", F.col("error").isNull().alias("sound"))


# --- evidence records

BASE, DIGEST = "https://example.org/schema", "sha256:" + "0" * 64
PROVEN = {
    "$schema": f"{BASE}/finding/v1", "id": "BF-0123456789", "weakness": "BGW-101", "probe": "own/empty@1", "level": "proven", "task": {"id": "t", "shape": "program"}, "battery": 2, "submission": {"kind": "source", "sha256": DIGEST},
    "ground": "structural", "verdict": {"reward": 1.0, "passed": True}, "baseline": {"passed": True}, "reproduce": {"script": "r.py", "sha256": DIGEST},
}
_SEEN = {"requirement": "It must.", "observation": "test -f x", "reference_passed": True, "presumed_correct_passed": [True] * 3, "submission_passed": False}


def without(d: dict, *keys: str) -> dict:
    return {k: v for k, v in d.items() if k not in keys}


#: A finding and whether it is sound.
FINDINGS = [
    (PROVEN, 1), (without(PROVEN, "submission"), 0), (PROVEN | {"verdict": {"reward": 0.0, "passed": False}}, 0), (without(PROVEN, "baseline"), 0), (PROVEN | {"ground": "differential"}, 0),
    (PROVEN | {"ground": "differential", "differentiating_input": {"input": "1", "reference_output": "2", "submission_output": "3"}}, 1), (PROVEN | {"differentiating_input": {"input": "1", "reference_output": "2", "submission_output": "2"}}, 0),
    (PROVEN | {"level": "proven-experimental", "ground": "differential", "differentiating_observation": _SEEN}, 1), (PROVEN | {"ground": "differential", "differentiating_observation": _SEEN}, 0),
    (PROVEN | {"level": "proven-experimental", "differentiating_observation": _SEEN | {"presumed_correct_passed": [True, True]}}, 0), (without(PROVEN, "submission", "verdict") | {"level": "lead", "reason": "not run"}, 1),
    (PROVEN | {"level": "lead"}, 0), (PROVEN | {"level": "excluded", "reason": "  "}, 0), (PROVEN | {"reason": None}, 0), (PROVEN | {"id": "BF-012345678L"}, 0), (PROVEN | {"battery": True}, 0), (PROVEN | {"claim": 1}, 0),
    (PROVEN | {"submission": {"kind": "workspace", "files": {"a.py": None}, "commands": [], "parameters": ["p"]}}, 1), (PROVEN | {"submission": {"kind": "workspace", "files": {}, "commands": [], "parameters": ["1p"]}}, 0),
    (PROVEN | {"run": {"tool": "t", "tool_version": "1", "conditions": {"cpus": 2, "net": False}}}, 1),
]


def texts(spark: SparkSession, sf_dir: str, cases: list) -> DataFrame:
    at = dealt(spark, sf_dir, "orders", "o_orderkey", [(json.dumps(d),) for d, _ in cases], "text string")
    return at.select(F.lit("orders").alias("file"), F.col("row").cast("long").alias("line"), "text")


def _soundness(cases: list) -> str:
    return f"SELECT o_orderkey AS line, sound, CASE WHEN sound THEN id END AS id FROM orders JOIN {table([(k, s, d['id']) for k, (d, s) in enumerate(cases)], 'k, s, id')} ON o_orderkey % {len(cases)} = k, LATERAL (SELECT s = 1 AS sound)"


@query("finding_records", _soundness(FINDINGS))
def findings_query(spark, sf_dir):
    return records.findings(texts(spark, sf_dir, FINDINGS), BASE).select("line", F.col("error").isNull().alias("sound"), "id")


REGISTERED = {
    "$schema": f"{BASE}/registry-record/v1", "schema_version": "1.0.0", "id": "BVR-2024-00001", "modified": "2024-05-01T00:00:00Z", "published": "2024-04-01T00:00:00Z", "summary": "A grader pays for nothing.", "weakness": ["BGW-101"],
    "affected": [{"artifact": {"kind": "grader", "name": "g"}, "shape": "program"}], "status": "reported", "numbering_authority": "n", "disclosure": {"maintainer_notified": "2024-01-01T00:00:00Z"},
}
_LATE = {"disclosure": {"maintainer_notified": "2024-03-01T00:00:00Z"}}
_EARLY = {"disclosure": {"maintainer_notified": "2024-03-01T00:00:00Z", "maintainer_agreed_early": True}}
_AT = REGISTERED["affected"][0]
REGISTRY = [
    (REGISTERED, 1), (REGISTERED | _LATE, 0), (REGISTERED | _EARLY, 0), (REGISTERED | _EARLY | {"status": "fixed"}, 1), (REGISTERED | {"disclosure": {"maintainer_notified": "2024-06-01T00:00:00Z"}}, 0), (REGISTERED | {"status": "withdrawn"}, 0),
    (REGISTERED | {"status": "withdrawn", "withdrawn": "2024-05-01T00:00:00Z"}, 1), (REGISTERED | {"weakness": ["BGW-9999"]}, 0), (REGISTERED | {"weakness": ["BGW-101", "BGW-101"]}, 0), (REGISTERED | {"published": "2024-02-30T00:00:00Z"}, 0), (REGISTERED | {"summary": "x" * 121}, 0),
    (REGISTERED | {"affected": [_AT | {"ranges": [{"type": "GIT", "events": [{"introduced": "0"}]}]}]}, 0), (REGISTERED | {"affected": [_AT | {"ranges": [{"type": "SEMVER", "events": [{"introduced": "0"}, {"fixed": "1.0"}]}]}]}, 1),
    (REGISTERED | {"affected": [_AT | {"ranges": [{"type": "SEMVER", "events": [{"introduced": "0", "fixed": "1"}]}]}]}, 0), (REGISTERED | {"references": [{"type": "GIT", "url": "https://x"}], "credits": [{"name": "n", "type": "TOOL"}]}, 1), (REGISTERED | {"affected": []}, 0),
]


@query("registry_records", _soundness(REGISTRY))
def registry_query(spark, sf_dir):
    return records.registry_records(texts(spark, sf_dir, REGISTRY), BASE, {"BGW-101"}).select("line", F.col("error").isNull().alias("sound"), "id")


_EVIDENCE = """SELECT CAST(o_orderkey AS VARCHAR(20)) AS finding, CASE o_orderkey % 5 WHEN 0 THEN 'lead' WHEN 1 THEN 'proven-experimental' WHEN 2 THEN 'observation' ELSE 'proven' END AS level, o_orderkey % 7 <> 0 AS has_submission,
    CASE WHEN o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'differential' ELSE 'structural' END AS ground, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 17 <> 0 END AS passed, o_orderkey % 19 <> 0 AS has_script,
    CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE o_orderkey % 29 <> 0 END AS baseline_passed, o_orderkey % 2 = 0 AS has_input, o_orderkey % 6 = 1 AS observed, o_orderkey % 31 <> 0 AS reference_passed, o_custkey % 5 AS presumed,
    o_custkey % 37 = 0 AS one_failed, o_custkey % 41 = 0 AS submission_passed, CASE WHEN o_orderkey % 10 = 0 THEN ' ' ELSE o_orderpriority END AS reason FROM orders"""


@query("evidence_faults", f"""WITH v AS ({_EVIDENCE}), p AS (SELECT *, reference_passed AND presumed >= 3 AND NOT one_failed AND NOT submission_passed AS proves FROM v)
SELECT finding, CASE WHEN level = 'observation' THEN NULL WHEN level = 'lead' THEN CASE WHEN trim(reason) = '' THEN 'no-reason' END
  WHEN NOT has_submission OR ground IS NULL OR passed IS NULL OR NOT has_script THEN 'incomplete' WHEN passed = FALSE THEN 'not-paid' WHEN baseline_passed IS DISTINCT FROM TRUE THEN 'no-baseline'
  WHEN ground = 'differential' AND NOT has_input AND NOT observed THEN 'no-difference' WHEN observed AND NOT proves THEN 'observation-proves-nothing' WHEN observed AND level = 'proven' THEN 'observation-is-experimental' END AS fault FROM p""")
def evidence_query(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    rows = spark.sql(_EVIDENCE.replace("FROM orders", "FROM {orders}"), orders=orders)
    return evidence.evidence_faults(rows.withColumn("presumed_correct", F.expr("transform(slice(array(true, true, true, true), 1, CAST(presumed AS INT)), x -> NOT one_failed)")))


_FINDING = """SELECT o_orderkey, 'https://example.org/schema/finding/v1' AS schema, 'BF-0123456789' AS id, 'BGW-101' AS weakness, 'own/empty@1' AS probe, CASE WHEN o_orderkey % 2 = 0 THEN 'lead' ELSE 'observation' END AS level, CAST(o_custkey AS VARCHAR(20)) AS task_id,
    'program' AS shape, 1 AS battery, CASE WHEN o_orderkey % 3 = 0 THEN 'structural' END AS ground, CAST(1.5 AS DOUBLE) AS reward, CASE WHEN o_orderkey % 5 = 0 THEN TRUE END AS passed, CASE WHEN o_orderkey % 7 = 0 THEN FALSE END AS baseline_passed, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END AS reason FROM orders"""


@query("finding_json", f"""WITH v AS ({_FINDING}) SELECT o_orderkey, '{{"$schema":"' || schema || '","id":"' || id || '","weakness":"' || weakness || '","probe":"' || probe || '","level":"' || level || '","task":{{"id":"' || task_id || '","shape":"' || shape || '"}},"battery":' || battery
  || coalesce(',"ground":"' || ground || '"', '') || CASE WHEN passed THEN ',"verdict":{{"reward":1.5,"passed":true}}' ELSE '' END || CASE WHEN baseline_passed = FALSE THEN ',"baseline":{{"passed":false}}' ELSE '' END || CASE WHEN reason <> '' THEN ',"reason":"' || reason || '"' ELSE '' END || '}}' AS record FROM v""")
def finding_json_query(spark, sf_dir):
    rows = spark.sql(_FINDING.replace("FROM orders", "FROM {orders}"), orders=spark.read.parquet(f"{sf_dir}/orders.parquet"))
    return rows.selectExpr("o_orderkey", f"{records.finding_json()} AS record")


_PATHS = """SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN '' WHEN 1 THEN '/' || p_brand WHEN 2 THEN 'a/../' || p_name WHEN 3 THEN 'C:x' WHEN 4 THEN '{test_root}/conftest.py' WHEN 5 THEN '{other}/x' WHEN 6 THEN 'a//b' WHEN 7 THEN 'src/.../m.py' WHEN 8 THEN 'a/' WHEN 9 THEN 'a' || chr(92) || 'b' ELSE p_brand || '/m.py' END AS path FROM part"""


@query("path_faults", f"""WITH v AS ({_PATHS}), s AS (SELECT *, string_split(path, '/') AS parts, regexp_extract_all(path, '\\{{([^{{}}]*)\\}}', 1) AS named FROM v)
SELECT p_partkey, CASE WHEN path = '' OR starts_with(path, '/') OR contains(path, chr(92)) THEN 'is not relative with forward slashes' WHEN regexp_matches(path, '^[A-Za-z]:') THEN 'starts with a drive'
  WHEN len(list_filter(parts, lambda x: x IN ('', '.', '..'))) > 0 THEN 'has an empty or dotted part' WHEN len(list_filter(named, lambda x: x <> 'test_root')) > 0 THEN 'names an undeclared parameter' END AS fault FROM s""")
def paths_query(spark, sf_dir):
    made = _PATHS.removeprefix("SELECT p_partkey, ").removesuffix(" FROM part")
    rows = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", made)
    return rows.selectExpr("p_partkey", f"{path_fault('path', 'array(' + repr('test_root') + ')')} AS fault")


# --- the rest of the statistics


@query("check_scores", f"""{duck("v_attempts", "v_controls", "v_runs")}, refused AS (SELECT DISTINCT task_id FROM v_controls WHERE baseline AND NOT accepted), past AS (SELECT task_id FROM v_attempts WHERE scale_exceeded UNION SELECT task_id FROM v_controls WHERE scale_exceeded),
o AS (SELECT task_id, max(accepted::INT) AS hit FROM v_attempts WHERE known_wrong AND accepted IS NOT NULL AND task_id NOT IN (SELECT task_id FROM refused) AND task_id NOT IN (SELECT task_id FROM past) GROUP BY task_id),
d AS (SELECT task_id, max((spread > 1e-9)::INT) AS hit FROM (SELECT task_id, submission, max(reward) - min(reward) AS spread FROM v_runs GROUP BY ALL HAVING count(*) > 1) GROUP BY task_id),
g AS (SELECT task_id, 1 - max(accepted::INT) AS hit FROM v_controls WHERE NOT baseline AND accepted IS NOT NULL GROUP BY task_id),
l AS (SELECT p_partkey AS task_id, (p_partkey % 3 = 0)::INT AS hit FROM part WHERE length(regexp_replace(p_brand, '[^A-Za-z0-9]', '', 'g')) >= 4)
SELECT c AS "check", count(*)::BIGINT AS measured, sum(hit)::BIGINT AS hits, round(avg(hit), 6) AS sub_score FROM (SELECT 'weak_oracle' AS c, hit FROM o UNION ALL SELECT 'determinism', hit FROM d UNION ALL SELECT 'ground_truth_rejected', hit FROM g UNION ALL SELECT 'answer_leakage', hit FROM l) GROUP BY c""")
def checks_query(spark, sf_dir):
    attempts, controls, runs = views(spark, sf_dir, "v_attempts", "v_controls", "v_runs")
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    tasks = part.selectExpr("CAST(p_partkey AS STRING) AS task_id", "p_name || ' and more' AS prompt", "p_brand AS reference")
    leaks = part.where("p_partkey % 3 = 0").selectExpr("CAST(p_partkey AS STRING) AS task_id")
    return rounded(evidence.check_scores(attempts, controls, runs, leaks, tasks))


_ONE = _models("v_results").replace("r AS (SELECT * FROM v_results)", "r AS (SELECT * FROM v_results WHERE model = 'A')")


@query("power_one_model", f"SELECT 'too-small' AS kind, model FROM ({_ONE}) WHERE detectable > 0.0001")
def one_model_query(spark, sf_dir):
    rows = view(spark, sf_dir, "v_results").where("model = 'A'")
    return power.findings(rows, 0.0001).where("kind = 'too-small'").select("kind", "model")


@query(
    "running_scores",
    f"""{duck("v_results")}, r AS (SELECT strftime(date_trunc('hour', TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 MINUTE * (line % 1000)), '%Y-%m-%d %H:%M:%S') AS start, model, coalesce(score / max_score, 0) AS v, score IS NULL AS e FROM v_results)
    SELECT start, model, count(*)::BIGINT AS samples, count(*) FILTER (e)::BIGINT AS errored, round(avg(v), 6) AS score FROM r GROUP BY start, model""",
)
def running_query(spark, sf_dir):
    rows = view(spark, sf_dir, "v_results").selectExpr("timestamp '2024-01-01 00:00:00' + make_dt_interval(0, 0, CAST(line % 1000 AS INT)) AS ts", "model", "score", "max_score")
    return rounded(running_scores(rows).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss")))
