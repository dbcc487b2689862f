"""Strict readers on broken input, the git source on a real repository, reports, streaming and exit codes."""

import json
import subprocess

import pytest

from scorewright import cli, plugins
from scorewright.functions import paths
from scorewright.operators import change_facts, error_rates, scoring
from scorewright.plans import reports
from scorewright.sources import dimensions, documents, git, records, strict
from scorewright.streaming.running import running_scores

GOOD = {"task_id": "t", "model": "m", "score": 1}


@pytest.mark.parametrize(
    "row,error",
    [(GOOD, None), (GOOD | {"other": 1}, None), (GOOD | {"score": None}, None), ({"model": "m", "score": 1}, "task_id is missing"), (GOOD | {"score": True}, "score is not a number"), (GOOD | {"sample": 1.0}, "sample is not an integer"), (GOOD | {"sample": -1}, "sample is below 0"), (GOOD | {"max_score": 0}, "max_score is not above 0"), (GOOD | {"cluster": None}, "cluster is null"), (GOOD | {"task_id": ""}, "task_id is empty"), ([], "not an object")],
)
def test_result_rows(row, error):
    assert strict.RESULTS.read(json.dumps(row))[1] == error


@pytest.mark.parametrize("text", ['{"a":1} x', "nope", "[" * 100_000, '{"task_id":"t","model":"m","score":1e400}', '{"task_id":"t","model":"m","score":' + "9" * 401 + "}", '{"task_id":"t","model":"m","score":NaN}'])
def test_bad_json(text):
    assert strict.RESULTS.read(text)[1] is not None


def test_lines_are_numbered_and_the_first_bad_one_is_named(spark, tmp_path):
    f = tmp_path / "r.jsonl"
    f.write_text("\n".join([json.dumps(GOOD), "", "  ", json.dumps(GOOD | {"model": "n"}), ""]))
    rows = strict.read_sound(spark, str(f), strict.RESULTS).orderBy("line").collect()
    assert [(r.line, r.model, r.max_score, r.sample) for r in rows] == [(1, "m", 1.0, None), (4, "n", 1.0, None)]
    f.write_text("\n\n{}\nnope\n")
    with pytest.raises(ValueError, match="line 3: task_id"):
        strict.read_sound(spark, str(f), strict.RESULTS)
    f.write_text("\n")
    with pytest.raises(ValueError, match="no rows"):
        strict.read_sound(spark, str(f), strict.RESULTS)
    assert strict.read_sound(spark, str(f), strict.PLANTED).count() == 0


def test_line_numbers_over_splits(spark, tmp_path):
    f = tmp_path / "big.txt"
    f.write_text("".join(f"row {i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = strict.numbered_lines(spark, str(f)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert all(r.text == f"row {r.line - 1}" for r in rows) and len(rows) == 20_000


def test_planted_implications():
    row = {"weakness": "BGW-1", "instance": "i", "tried": True, "accepted": False, "proven": True}
    assert strict.PLANTED.read(json.dumps(row))[1] == "proven without accepted"


def test_documents(spark):
    text = 'version = 1\n[[decision]]\nfinding = "BF-0123456789"\naction = "ignore"\nreason = "so \\"it\\" is"\ndecided = 2024-01-01\nexpires = 2024-02-01\n'
    rows = documents.decisions(spark, text).collect()
    assert documents.decisions(spark, documents.format_decisions(rows)).collect() == rows
    for bad in (text.replace("2024-02-01", "2023-02-01"), text + text.split("\n", 1)[1], text.replace("ignore", "hide"), "version = 2", "="):
        with pytest.raises(ValueError):
            documents.decisions(spark, bad)


BASE, DIGEST = "https://example.org/schema", "sha256:" + "0" * 64
RUN = {"reward": 1.0, "passed": True}
REPORT = {"$schema": f"{BASE}/reproduction-result/v1", "finding": "BF-0123456789", "submission": {"kind": "source", "sha256": DIGEST}, "runs": [RUN] * 3, "baseline_runs": [RUN] * 3, "outcome": "reproduced"}


def test_reproductions():
    assert records.read_reproduction("noise\n" + json.dumps(REPORT) + "\n\n", 0, BASE)["outcome"] == "reproduced"
    no = {"reward": 0.0, "passed": False}
    assert records.read_reproduction(json.dumps(REPORT | {"runs": [RUN, no, RUN], "outcome": "flaky"}), 2, BASE)["outcome"] == "flaky"
    for out, code in ((json.dumps(REPORT), 1), (json.dumps(REPORT | {"outcome": "flaky"}), 2), (json.dumps(REPORT | {"extra": 1}), 0), (json.dumps(REPORT | {"finding": "x"}), 0), (json.dumps(REPORT | {"runs": [RUN] * 2, "outcome": "error"}), 4), (json.dumps(REPORT | {"runs": [RUN | {"x": 1}] * 3}), 0), ("", 0), ("[]", 0), ("NaN", 0)):
        with pytest.raises(ValueError):
            records.read_reproduction(out, code, BASE)


SCRIPT = f"""# /// script
# requires-python = ">=3.11"
# [tool.own]
# schema = "{BASE}/reproduction/v1"
# finding = "BF-0123456789"
# probe = "own/empty@1"
# runs = 3
# [tool.own.submission]
# kind = "source"
# sha256 = "{DIGEST}"
# ///
import subprocess
print("{BASE}/reproduction-result/v1")
"""


@pytest.mark.parametrize(
    "old,new,problem",
    [("", "", None), ("# requires-python", "# other", "requires-python"), ("reproduction/v1", "reproduction/v2", "schema"), ("0123456789", "0123456780", "finding"), ("own/empty@1", "own/empty@2", "probe"), ("0" * 64, "1" * 64, "submission"), ("runs = 3", "runs = 2", "runs"), ("import subprocess", "import own, subprocess", "imports own"), ("import subprocess", "import subprocess, socket", "network"), ("import subprocess", "import json", "process"), ("result/v1", "result/v9", "result"), ("print(", "print((", "Python"), ("# ///\nimport", "import", "metadata")],
)
def test_scripts(old, new, problem):
    found = records.script_problems(SCRIPT.replace(old, new) if old else SCRIPT, {"id": "BF-0123456789", "probe": "own/empty@1", "submission": {"kind": "source", "sha256": DIGEST}}, BASE, "own")
    assert (found == []) if problem is None else any(problem in f for f in found), found


def test_records_from_files(spark, tmp_path):
    good = {"$schema": f"{BASE}/finding/v1", "id": "BF-0123456789", "weakness": "BGW-1", "probe": "a/b@1", "level": "observation", "task": {"id": "t", "shape": "io"}, "battery": 1}
    (tmp_path / "f.jsonl").write_text(json.dumps(good) + "\n\n" + json.dumps(good | {"level": "lead"}) + "\n{\n")
    rows = records.findings(records.documents(spark, str(tmp_path / "f.jsonl"), False), BASE).orderBy("line").collect()
    assert [(r.line, r.error is None, r.shape) for r in rows] == [(1, True, "io"), (3, False, None), (4, False, None)]
    (tmp_path / "one.json").write_text(json.dumps(good, indent=1))
    assert [r.id for r in records.findings(records.documents(spark, str(tmp_path / "one.json"), True), BASE).collect()] == ["BF-0123456789"]


LIST = """version = 1
[families]
a = "First"
[[weakness]]
id = "BGW-12"
name = "Twelve"
family = "a"
mechanism = "It happens."
shapes = ["program"]
grounds = ["structural"]
evidence = ["fact"]
provides = []
fix = "Mend it."
sources = ["https://example.org/12"]
[[weakness]]
id = "BGW-9"
name = "Nine"
family = "a"
mechanism = "It happens too."
shapes = ["io", "program"]
grounds = []
evidence = ["statistic"]
provides = ["fact"]
fix = "Mend it too."
sources = ["https://example.org/9"]
status = "deprecated"
[crosswalk.other]
title = "Other"
source = "https://example.org"
map = { x = ["BGW-9"], y = [] }
"""
PROBES = """[[probe]]
id = "own/empty@1"
operator = "drop_side_effect"
weakness = ["BGW-9", "BGW-12"]
title = "Empty"
shapes = ["program"]
ground = "structural"
expect = "reject"
maturity = "experimental"
battery = 1
sources = ["https://example.org"]
attribution = [{ weakness = "BGW-12", when_rejected = "own/twice@1", reason = "so" }]
[probe.template]
solution = "reference-emptied"
files = { "{root}/x.py" = "x" }
parameters = ["root"]
[[probe]]
id = "own/twice@1"
operator = "twice"
weakness = ["BGW-9"]
title = "Twice"
shapes = ["program"]
expect = "consistent"
maturity = "stable"
battery = 1
sources = ["https://example.org"]
template = { solution = "reference" }
"""


def test_documents_are_read_by_all_cores(spark):
    texts = spark.range(0, 8, 1, 1).selectExpr("'f' AS file", "id AS line", "'{}' AS text")
    for read in (records.registry_records(texts, "https://example.org", set()), records.findings(texts, None), strict.checked(texts, strict.RESULTS)):
        assert read.rdd.getNumPartitions() >= 4 and read.where("error IS NOT NULL").count() == 8


def test_dimensions(spark):
    assert [r.id for r in dimensions.weaknesses(spark, LIST).collect()] == ["BGW-9", "BGW-12"]
    assert {(r.category, tuple(r.weakness)) for r in dimensions.crosswalks(spark, LIST).collect()} == {("x", ("BGW-9",)), ("y", ())}
    known = {"BGW-9", "BGW-12"}
    rows = dimensions.probes(spark, PROBES, known).collect()
    assert [(r.probe, [tuple(x) for x in r.rules]) for r in rows] == [("own/empty@1", [("BGW-12", "own/twice@1")]), ("own/twice@1", [])]
    page = dimensions.weakness_markdown(LIST)
    assert page.index("### BGW-9") < page.index("### BGW-12") and "**Nine** (deprecated). It happens too." in page and "| y | none (not a grader weakness) |" in page
    for old, new in (("BGW-12", "BGW-9"), ('family = "a"', 'family = "b"'), ("https://example.org/9", "http://example.org/9"), ('["statistic"]', "[]"), ('x = ["BGW-9"]', 'x = ["BGW-8"]'), ("version = 1", "version = 0"), ("[families]", "[families")):
        with pytest.raises(ValueError):
            dimensions.weaknesses(spark, LIST.replace(old, new))
    for old, new in (('operator = "twice"', 'operator = "drop_side_effect"'), ('when_rejected = "own/twice@1"', 'when_rejected = "own/empty@1"'), ('weakness = "BGW-12"', 'weakness = "BGW-9"'), ('ground = "structural"\n', ""), ("{root}", "{other}"), ('expect = "consistent"', 'expect = "reject"'), ('"BGW-9", "BGW-12"', '"BGW-8", "BGW-12"')):
        with pytest.raises(ValueError):
            dimensions.probes(spark, PROBES.replace(old, new), known)
    suite = '[suite]\nlevel = "BCL-1"\nversion = 1\n[[fixture]]\nid = "bcl-1/a-b/defect"\nweakness = "BGW-9"\nshape = "io"\ndefect = true\n'
    assert dimensions.fixtures(spark, suite, "BCL-1").first().defect
    with pytest.raises(KeyError):
        dimensions.fixtures(spark, suite, "BCL-2")


def test_conformance_report(spark, tmp_path, capsys):
    suite = '[suite]\nlevel = "BCL-1"\nversion = 1\n' + "".join(f'[[fixture]]\nid = "bcl-1/a/{k}"\nweakness = "BGW-9"\nshape = "io"\ndefect = {str(k == "defect").lower()}\n' for k in ("defect", "correct"))
    ran = lambda k, *flags: {"fixture": f"bcl-1/a/{k}", "status": "ran", "flagged": list(flags)}
    doc = {"$schema": f"{BASE}/conformance-results/v1", "suite": {"level": "BCL-1", "version": 1}, "tool": {"name": "t", "version": "1"}, "results": [ran("defect", "BGW-9"), ran("correct")]}
    s, f = tmp_path / "s.toml", tmp_path / "r.json"
    s.write_text(suite), f.write_text(json.dumps(doc))
    assert cli.main(["conformance", str(s), str(f)]) == 0 and "achieved: every defect was flagged" in capsys.readouterr().out
    f.write_text(json.dumps(doc | {"results": [{"fixture": "bcl-1/a/defect", "status": "skipped"}, ran("correct", "BGW-9")]}))
    assert cli.main(["conformance", str(s), str(f), "--json"]) == 1 and json.loads(capsys.readouterr().out)["outcomes"][0]["not_run"] == ["bcl-1/a/defect"]
    for bad in (doc | {"results": [ran("defect"), ran("defect")]}, doc | {"results": [{"fixture": "bcl-1/a/defect", "status": "unsupported"}]}, doc | {"results": [{"fixture": "bcl-1/a/defect", "status": "ran"}]}, doc | {"tool": {"name": "t"}}, doc | {"results": [ran("defect", "weak")]}):
        f.write_text(json.dumps(bad))
        assert cli.main(["conformance", str(s), str(f)]) == 2


def test_texts(spark):
    outcomes = spark.createDataFrame([("f", "p", 1, "proven", o, d) for o, d in (("stands", False), ("disputed", False), ("withdrawn-after-dispute", True))], "finding string, probe string, battery int, level string, outcome string, dismissed boolean")
    planted = spark.createDataFrame([("BGW-2", "i", True, True, False)], "weakness string, instance string, tried boolean, accepted boolean, proven boolean")
    text = reports.error_rate_text(error_rates.precision(outcomes), error_rates.recall(planted))
    assert "battery 1 · every probe: 500 false accusations per 1,000 (95% CI 95–905), 1 of 2; 1 under open dispute, counted neither way; dismissed 1 of 3" in text and "BGW-2: 1 planted · tried 1 (21–100%)" in text
    tasks = spark.createDataFrame([("t", "io", 1), ("u", "program", 2), ("v", "io", 3)], "task_id string, shape string, ordinal int")
    attempts = spark.createDataFrame([("t", "op", True, False, False), ("u", "op", True, True, False), ("v", "op", True, True, True)], "task_id string, operator string, known_wrong boolean, accepted boolean, scale_exceeded boolean")
    controls = spark.createDataFrame([("t", "oracle", True, True, False, 1), ("t", "reformatted", False, True, False, 2)], "task_id string, relation string, baseline boolean, accepted boolean, scale_exceeded boolean, ordinal int")
    categories = spark.createDataFrame([("op", "weak_tests")], "operator string, category string")
    card = reports.scorecard_text(scoring.scorecard(tasks, attempts, controls, categories), scoring.exclusions(tasks, attempts, controls)).split("\n")
    assert card[0].startswith("program: 1 task scored") and card[3].startswith("io: 1 task") and card[6].startswith("overall: 2 tasks") and card[-1] == "not measured: v (io): the grader paid past full marks"


class Mine(plugins.Operator):
    id = "mine"
    shapes = ("io",)

    def apply(self, task):
        yield {"text": "print(1)", "ground": "invariant"}
        raise RuntimeError("no more")


class Other(plugins.Operator):
    plugin_api = 2


class Entry:
    def __init__(self, name, dist, thing):
        self.name, self.dist, self.thing = name, type("Dist", (), {"name": dist}), thing

    def load(self):
        if isinstance(self.thing, Exception):
            raise self.thing
        return self.thing


def test_extensions(spark):
    found = [Entry("a", "zeta", Other), Entry("mine", "zeta", Other), Entry("mine", "alpha", Mine), Entry("b", "alpha", ValueError("x")), Entry("c", "alpha", print), Entry("d", "alpha", int)]
    with pytest.warns(UserWarning) as said:
        assert plugins.load(plugins.OPERATORS, found, plugins.Operator) == {"mine": Mine}
    assert len(said) == 5 and plugins.load(plugins.COMMANDS) == {} and len(plugins.GROUPS) == 6
    with pytest.raises(ValueError):
        plugins.load("other.things")
    with pytest.warns(UserWarning):
        made = list(plugins.extended({"mine": Mine})("x", "io"))
    assert [(c.operator, c.text, c.ground) for c in made] == [("mine", "print(1)", "invariant")] and list(plugins.extended({"mine": Mine})("x", "program")) == []


@pytest.mark.parametrize("path,fault", [("a/b.py", False), ("", True), ("/a", True), ("a/../b", True), ("a//b", True), ("a/", True), ("C:x", True), ("a\\b", True), ("{p}/x", False), ("{q}/x", True), (".../x", False), ("./x", True)])
def test_paths(spark, path, fault):
    assert (paths.path_problem(path, {"p"}) is not None) == fault
    assert (spark.createDataFrame([(path, ["p"])], "path string, p array<string>").selectExpr(paths.path_fault("path", "p")).first()[0] is not None) == fault


def test_large_files_and_odd_revisions(spark, tmp_path):
    repo = tmp_path / "r"
    repo.mkdir()
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init", "-q")
    (repo / "test_big.py").write_text("def test_x():\n    assert f() == 1\n" + "# filler\n" * 300_000)
    (repo / "test_ä b.py").write_text("def test_y():\n    assert f() == 1\n")
    run("add", "."), run("commit", "-qm", "start")
    (repo / "test_big.py").write_text("x = 1\n")
    (repo / "test_ä b.py").write_text("def test_y():\n    assert f()\n")
    spark.dataSource.register(git.GitChange)
    rows = {r.path: r for r in spark.read.format("git_change").options(repo=str(repo), since="HEAD").load().collect()}
    assert rows["test_big.py"].fault == "too large" and rows["test_big.py"].after is None and rows["test_ä b.py"].before.endswith("== 1\n")
    for odd in ("--all", "-h", "nothing"):
        with pytest.raises(ValueError):
            git.resolve(str(repo), odd)
    report = reports.verify_report(spark.read.format("git_change").options(repo=str(repo), since="HEAD").load(), None, git.resolve(str(repo), "HEAD"), [])
    assert [f["rule"] for f in report["facts"]] == ["check-weakened"] and "test_big.py (not UTF-8, too large or unreadable)" in report["not_checked"]
    assert "1 fact and 0 observations" in reports.verify_text(report)


def test_git_change_and_exit_codes(spark, tmp_path):
    repo = tmp_path / "r"
    (repo / "tests").mkdir(parents=True)
    run = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=a", "-c", "user.email=a@b.c", *a], check=True, capture_output=True)
    run("init", "-q")
    test = repo / "tests" / "test_a.py"
    test.write_text("def test_x():\n    assert f() == 1\n")
    run("add", "."), run("commit", "-qm", "start")
    base = git.default_base(str(repo))
    test.write_text("def test_x():\n    assert f()\n")
    (repo / "link.py").symlink_to("/etc/passwd")
    run("add", "tests"), run("commit", "-qm", "Fix it")
    spark.dataSource.register(git.GitChange)
    change = spark.read.format("git_change").options(repo=str(repo), since=base).load()
    assert [(r.path, r.fault) for r in change.collect()] == [("tests/test_a.py", None)]
    facts = change_facts.change_facts(change)
    assert [r.rule for r in facts.collect()] == ["check-weakened"]
    log = json.loads(reports.sarif(facts, "t"))
    assert log["runs"][0]["results"][0]["ruleId"] == "check-weakened" and len(log["runs"][0]["tool"]["driver"]["rules"]) == 18
    assert cli.main(["verify", str(repo), "--since", base]) == 1 and cli.main(["verify", str(repo), "--since", "HEAD"]) == 0
    assert cli.main(["nothing"]) == 64


def test_power_report(spark, tmp_path, capsys):
    f = tmp_path / "r.jsonl"
    f.write_text("\n".join(json.dumps({"task_id": f"t{i}", "model": m, "score": int(i % 3 > 0)}) for i in range(20) for m in "ab"))
    assert cli.main(["power", str(f), "--json"]) == 0
    report = json.loads(capsys.readouterr().out)
    assert report["tasks"] == 20 and report["models"][0]["method"] == "wilson" and report["comparisons"][0]["difference"] == 0
    assert cli.main(["power", str(f), "--min-difference", "0.01"]) == 0
    f.write_text("{}")
    assert cli.main(["power", str(f)]) == 2


def test_streaming_equals_batch(spark, tmp_path):
    rows = spark.range(100).selectExpr("timestamp_seconds(id * 60) AS ts", "CASE WHEN id % 2 = 0 THEN 'a' ELSE 'b' END AS model", "CASE WHEN id % 10 > 0 THEN CAST(id % 3 AS DOUBLE) END AS score", "2.0D AS max_score")
    rows.write.parquet(str(tmp_path / "in"))
    stream = running_scores(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.outputMode("update").format("memory").queryName("running").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("running").collect())) == sorted(map(tuple, running_scores(rows).collect()))
