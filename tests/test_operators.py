"""Published values, rules tested both ways, and plain-Python versions."""

import math
import statistics

import pytest

from scorewright.functions import candidates, ids, programs, syntax
from scorewright.functions.intervals import wilson
from scorewright.operators import battery, change_facts, error_rates, evidence, power, scoring

RESULT = "line long, task_id string, model string, score double, max_score double, cluster string, sample long"


@pytest.mark.parametrize("k,n,low,high", [(0, 10, 0, 0.2775), (5, 10, 0.2366, 0.7634), (10, 10, 0.7225, 1), (2, 2, 0.3424, 1), (1, 20, 0.0089, 0.2361)])
def test_wilson_values(spark, k, n, low, high):
    lo, hi = spark.range(1).selectExpr(*wilson(str(k), str(n))).first()
    assert (round(lo, 4), round(hi, 4)) == (low, high)


def test_wilson_contains_its_rate_and_refuses(spark):
    lo, hi = wilson("k", "n")
    all_ = spark.sql("SELECT n, k FROM (SELECT explode(sequence(1, 29)) AS n) LATERAL VIEW explode(sequence(0, n)) e AS k").selectExpr("k / n AS p", f"{lo} AS lo", f"{hi} AS hi")
    assert all_.where("NOT (lo <= p AND p <= hi)").count() == 0
    assert spark.range(1).selectExpr(wilson("1", "0")[0]).first()[0] is None
    with pytest.raises(Exception):
        spark.range(1).selectExpr(wilson("3", "2")[0]).collect()


def test_power_by_hand(spark):
    rows = spark.createDataFrame([(1, "a", "m", 1.0, 1.0, None, 0), (2, "b", "m", None, 1.0, None, 0), (3, "c", "m", 2.0, 4.0, None, 0), (4, "c", "m", 4.0, 4.0, None, 1)], RESULT)
    r = power.model_scores(rows).first()
    values = [1.0, 0.0, 0.75]
    se = statistics.stdev(values) / math.sqrt(3)
    assert math.isclose(r.score, statistics.mean(values)) and math.isclose(r.standard_error, se) and math.isclose(r.score_errors_dropped, 0.875)
    assert math.isclose(r.detectable, 2.8015852181129686 * math.sqrt(2) * se) and r.method == "normal" and r.few_tasks


def test_clusters_widen_the_error(spark):
    data = [(i, f"t{i}", "m", float(i % 4 < 2), 1.0, f"c{i // 2}", 0) for i in range(8)]
    one = power.model_scores(spark.createDataFrame(data, RESULT)).first()
    v = [d[3] for d in data]
    mu, n = statistics.mean(v), len(v)
    cross = sum(sum(x - mu for x in v[2 * c : 2 * c + 2]) ** 2 - sum((x - mu) ** 2 for x in v[2 * c : 2 * c + 2]) for c in range(4))
    assert math.isclose(one.standard_error, math.sqrt(statistics.variance(v) / n + cross / n**2)) and one.method == "normal clustered"


def test_pairs_without_shared_tasks_and_too_small(spark):
    rows = spark.createDataFrame([(1, "a", "x", 1.0, 1.0, None, 0), (2, "b", "y", 1.0, 1.0, None, 0), (3, "a", "z", 0.0, 1.0, None, 0), (4, "b", "z", 1.0, 1.0, None, 0)], RESULT)
    pairs = {(r.first, r.second): r for r in power.comparisons(rows).collect()}
    assert pairs["x", "y"].tasks == 0 and pairs["x", "y"].difference is None and pairs["x", "z"].tasks == 1 and pairs["x", "z"].low is None
    assert {r.kind for r in power.findings(rows).collect()} == {"missing-tasks"}


def test_dispute_counts_neither_way(spark):
    rows = [("f", "p", 1, "proven", o, False) for o in ("stands", "disputed", "withdrawn-after-dispute")]
    df = spark.createDataFrame(rows, "finding string, probe string, battery int, level string, outcome string, dismissed boolean")
    r = error_rates.precision(df).where("probe IS NULL").first()
    assert (r.n_false, r.resolved, r.disputed, r.reported) == (1, 2, 1, 3)
    ok = error_rates.precision(spark.createDataFrame([("f", "p", 1, "proven", "stands", False)] * 40, df.schema)).first()
    assert (ok.low, round(ok.high)) == (0, 88)


def test_recall_refuses_a_second_listing(spark):
    df = spark.createDataFrame([("BGW-2", "i", True, True, True)] * 2, "weakness string, instance string, tried boolean, accepted boolean, proven boolean")
    with pytest.raises(Exception, match="listed twice"):
        error_rates.recall(df).collect()


def test_coverage_leaves_out_what_was_not_measured(spark):
    rows = [("t", "op", True, None, False), ("t", "op", False, True, False), ("u", "op", True, True, True), ("v", "op", True, False, False), ("v", "op", True, True, False)]
    a = spark.createDataFrame(rows, "task_id string, operator string, known_wrong boolean, accepted boolean, scale_exceeded boolean")
    c = spark.createDataFrame([("op", "")], "operator string, category string")
    out = {r.category: (r.caught, r.measured) for r in scoring.coverage(a, c).collect()}
    assert out == {"other": (0, 1), None: (0, 1)}


@pytest.mark.parametrize(
    "runs,baseline,error,outcome",
    [([True] * 3, [True] * 3, "", "reproduced"), ([False] * 3, [True] * 3, "", "not-reproduced"), ([True, False, True], [True] * 3, "", "flaky"), ([True] * 3, [False] * 3, "", "baseline-failed"), ([True] * 2, [True] * 3, "", "error"), ([True] * 3, [True] * 3, "x", "error")],
)
def test_judge(spark, runs, baseline, error, outcome):
    df = spark.createDataFrame([(runs, baseline, error)], "runs array<boolean>, baseline array<boolean>, error string")
    assert evidence.judge(df).first().outcome == outcome


def test_ids(spark):
    values = ["BGW-7", "BGW-07", "BGW-7\n", "xBGW-7"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert [r[0] for r in df.selectExpr(ids.is_id("weakness", "v")).collect()] == [True, False, False, False]
    assert ids.canonical_json({"b": [1, True, None], "a": "é"}) == '{"a":"é","b":[1,true,null]}'.encode()
    for bad in (1.5, 2**53, {1: 2}):
        with pytest.raises((TypeError, ValueError)):
            ids.canonical_json(bad)
    parts = ["p", "t", "fp", {"kind": "source", "sha256": "x"}]
    text = ids.canonical_json(parts).decode()
    assert spark.createDataFrame([(text,)], "c string").selectExpr(ids.finding_id("c")).first()[0] == ids.finding_id_of(*parts)


@pytest.mark.parametrize("a,b,name", [("x", "x", "exact"), (" x", "x", "whitespace"), ("X", "x", "case"), ("1", "1.00", "numeric"), ("[]", "[ ]", "literal"), ('{"a":1}', '{"a": 1}', "literal"), ("yes", "TRUE", "boolean"), ("[[0]]", "0", "singleton"), ("a", "b", None), ("null", " null", "whitespace"), ("[true]", "true", "singleton")])
def test_ladder(a, b, name):
    assert programs.collision(a, b) == name


def test_programs():
    assert programs.same_program("x = 1  # c\n", "x = 1\n") and not programs.same_program("", "70") and not programs.same_program("x = 1", "x = 2") and not programs.same_program("(", "x = 1")
    source = "def f(a):\n    total = a  # keep\n    return total\n"
    for name, rewrite in programs.RELATIONS.items():
        new = rewrite(source)
        scope, other = {}, {}
        exec(source, scope), exec(new, other)
        assert new != source and scope["f"](3) == other["f"](3) == 3, name
    assert programs.renamed_locals("def f():\n    x = 1\n    return locals()\n") is None and programs.comment_free("x = 1\n") is None


SOLVE = "def solve(items):\n    total = 0\n    for x in items:\n        if x > 0:\n            total += x\n    return total\n"


def test_candidates_do_no_work():
    made = {c.operator: c for c in candidates.candidates(SOLVE, "program")}
    assert made["drop_side_effect"].text == "def solve(items):\n    pass\n" and made["constant_implementation"].text.endswith("return 0\n") and len(made) == 5
    for c in made.values():
        compile(c.text, "?", "exec")
    for silent in ("class A:\n    def f(self): raise NotImplementedError\n", "print(1)\ndef unused():\n    work()\n", "(", "", "70"):
        assert list(candidates.candidates(silent, "program")) == []
    lead = candidates.candidate("constant_implementation", "def f():\n    return 5\n\ndef g(x):\n    print(x)\n")
    assert lead.ground is None
    assert {c.operator for c in candidates.candidates(SOLVE, "container")} == set(candidates.WORKSPACES)


def test_battery(spark):
    tasks = spark.createDataFrame([("a", "program", SOLVE), ("b", "program", None), ("c", "io", SOLVE), ("d", "workspace", SOLVE)], "task_id string, shape string, reference string")
    got = battery.battery(tasks).groupBy("task_id").count().collect()
    assert {r.task_id: r["count"] for r in got} == {"a": 5, "d": 3}
    assert {tuple(r) for r in battery.battery_counts(tasks).collect()} == {("a", 5, 0, 0), ("d", 3, 0, 0)}
    controls = [(r.relation, r.nth) for r in battery.positive_controls(tasks.where("task_id = 'a'")).orderBy("nth").collect()]
    assert controls == [("oracle", 0), ("renamed_locals", 3)]


def nodes(df, name):
    return df._jdf.queryExecution().executedPlan().toString().count(name + " ")


def test_battery_is_made_once_by_all_cores(spark):
    tasks = spark.range(0, 30, 1, 1).selectExpr("CAST(id AS STRING) AS task_id", "'program' AS shape", f"concat({SOLVE!r}, '# ', id % 2) AS reference")
    dealt = [battery.proposals(tasks), battery.positive_controls(tasks)]
    assert all("REPARTITION_BY_NUM" in d._jdf.queryExecution().executedPlan().toString() for d in dealt)
    assert dealt[0].rdd.getNumPartitions() >= 4
    counts = battery.battery_counts(tasks)
    assert nodes(counts, "MapInArrow") == 1
    assert {tuple(r)[1:] for r in counts.collect()} == {(5, 0, 0)} and counts.count() == 30
    assert battery.positive_controls(tasks).groupBy("relation").count().count() == 3
    once, again = ([(c.operator, c.text) for c in candidates.candidates(SOLVE, "program")] for _ in range(2))
    assert once == again


BEFORE = "def test_x():\n    assert f(1) == 2\n    assert g() == 3\n"
CASES = {
    "tests-removed": ("tests/test_a.py", BEFORE + "\ndef test_y():\n    assert h() == 1\n", BEFORE),
    "skips-added": ("tests/test_a.py", BEFORE, "import pytest\n@pytest.mark.skip\n" + BEFORE),
    "conditional-skips-added": ("tests/test_a.py", BEFORE, "import pytest\n@pytest.mark.skipif(1, reason='')\n" + BEFORE),
    "trivial-checks-added": ("tests/test_a.py", BEFORE, BEFORE + "    assert True\n"),
    "tests-without-checks": ("tests/test_a.py", BEFORE, BEFORE + "\ndef test_new():\n    pass\n"),
    "report-hook-added": ("tests/conftest.py", "", "def pytest_runtest_makereport(item):\n    pass\n"),
    "check-weakened": ("tests/test_a.py", BEFORE, "def test_x():\n    assert f(1)\n    assert g()\n"),
    "tolerance-loosened": ("tests/test_a.py", "def test_x():\n    assert f() == approx(1)\n", "def test_x():\n    assert f() == approx(1, rel=0.1)\n"),
    "timeout-raised": ("tests/test_a.py", "@pytest.mark.timeout(1)\n" + BEFORE, "@pytest.mark.timeout(9)\n" + BEFORE),
    "expected-value-changed": ("tests/test_a.py", BEFORE, BEFORE.replace("== 3", "== 4")),
    "failure-swallowed": ("tests/test_a.py", BEFORE, "def test_x():\n    try:\n        assert f(1) == 2\n        assert g() == 3\n    except AssertionError:\n        pass\n"),
    "subject-mocked": ("tests/test_a.py", "def test_parse():\n    assert parse() == 1\n", "def test_parse():\n    patch('m.parse')\n    assert parse() == 1\n"),
    "checks-removed": ("tests/test_a.py", BEFORE, "def test_x():\n    assert f(1) == 2\n"),
    "timer-reassigned": ("src/m.py", "x = 1\n", "import time\ntime.time = lambda: 0\n"),
    "exit-added": ("src/m.py", "x = 1\n", "import sys\nsys.exit(0)\n"),
    "always-equal-added": ("src/m.py", "x = 1\n", "class A:\n    def __eq__(self, o):\n        return True\n"),
    "replaced-by-stub": ("src/m.py", "def f(x):\n    return x + 1\n", "def f(x):\n    ...\n"),
    "selection-changed": ("pytest.ini", "[pytest]\naddopts = -q\n", "[pytest]\naddopts = -k one\n"),
}


def test_change_facts_catch_and_stay_quiet(spark):
    rows = [(rule, path, a, b) for rule, (path, a, b) in CASES.items()]
    rows += [(f"honest {rule}", path, a, a + "\n# a comment\n") for rule, (path, a, _) in CASES.items()]
    rows += [("moved", "tests/test_a.py", BEFORE, None), ("moved", "tests/unit/test_b.py", None, BEFORE), ("bad", "tests/test_c.py", "def (", "x = 1\n")]
    facts = change_facts.change_facts(spark.createDataFrame(rows, "change string, path string, before string, after string")).collect()
    found = {}
    for f in facts:
        found.setdefault(f.change, set()).add(f.rule)
    assert set(found) == set(CASES)
    for rule in CASES:
        assert rule in found[rule], (rule, found[rule])


def test_changes_are_read_once_by_all_cores(spark):
    files = spark.range(0, 8, 1, 1).selectExpr("CAST(id AS STRING) AS change", "'tests/test_a.py' AS path", f"{BEFORE!r} AS before", f"concat({BEFORE!r}, '# ', id) AS after")
    features = change_facts.file_features(files)
    assert features.rdd.getNumPartitions() >= 4
    matches, facts = change_facts.test_matches(features), change_facts.change_facts(files)
    assert nodes(matches, "MapInPandas") == nodes(facts, "MapInPandas") == 0  # both come from what was read before
    assert matches.count() == 8 and facts.count() == 0


def test_strength():
    import ast

    grade = lambda body: syntax.strength(ast.parse("def test_a():\n    " + body).body[0])
    assert [grade(b) for b in ("assert x == 1", "assert x in y", "assert x == 1; assert x in y", "pass", "assert x is not None", "assert x", "m.assert_called_once()", "snapshot.assert_match(x)", "assert x == 1 or x")] == ["S1", "S2", "S3", "W1", "W2", "W3", "W4", "W5", "W3"]


def test_line_numbers_beyond_bigint(spark, tmp_path):
    from scorewright.plans.queries import QUERIES

    def lines(folder, *orders):
        made = [(o, 7, 3, n, 12.34, d, 0.0, "A" if o % 2 else "N") for o in orders for n, d in ((1, 0.05), (1, 0.1))]
        kind = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_discount double, l_tax double, l_returnflag string"
        spark.createDataFrame(made, kind).write.parquet(str(tmp_path / folder / "lineitem.parquet"))
        return str(tmp_path / folder)

    near, far = lines("near", 1, 2), lines("far", 1, 9_000_000)
    for name in ("counts", "duplicates", "findings", "flags", "one_model", "model_scores", "outside", "pairs"):
        assert QUERIES[f"power_{name}"](spark, far).count() == QUERIES[f"power_{name}"](spark, near).count(), name
    assert QUERIES["running_scores"](spark, far).count() == 2
    at = lambda o: ((o * 100000 + 7) * 1000 + 3) * 100000 + 1234
    first = lambda d: {(r.model, int(r.first_outside)) for r in QUERIES["power_outside"](spark, d).where("outside > 0").collect()}
    assert first(far) == {("A", at(1)), ("N", at(9_000_000))} and first(near) == {("A", at(1)), ("N", at(2))}
    kind = lambda d: dict(QUERIES["power_outside"](spark, d).dtypes)["first_outside"]
    assert (kind(near), kind(far)) == ("bigint", "decimal(38,0)")
