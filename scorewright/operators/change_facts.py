"""Facts about how a change weakened its tests: one Python stage reads the syntax, joins and filters do the rest.

files: change, path, before, after (texts, null where absent). A fact is change, rule, weakness, kind, path, subject,
line and detail.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorewright.functions import syntax
from scorewright.functions.share import dealt_evenly, read_once

TEST = "struct<name:string,bare:string,tree:string,line:int,checks:int,strength:string,tolerances:map<string,double>,timeout:double,expected:map<string,string>,swallowed:int,mocked:array<string>>"
FEATURES = (
    "change string, path string, side string, present boolean, parsed boolean, selection map<string,string>, skips int, conditional_skips int, trivial array<int>, hooks array<string>, patches_reports boolean, "
    f"timers array<string>, exits int, always_equal int, functions array<string>, stubs array<string>, first_lines map<string,int>, tests array<{TEST}>"
)
#: rule: (weakness, kind)
RULES = {
    "tests-removed": ("109", "fact"), "skips-added": ("109", "fact"), "conditional-skips-added": ("109", "observation"), "trivial-checks-added": ("109", "observation"),
    "tests-without-checks": ("109", "observation"), "report-hook-added": ("108", "fact"), "check-weakened": ("109", "fact"), "tolerance-loosened": ("134", "fact"), "timeout-raised": ("109", "fact"),
    "expected-value-changed": ("109", "observation"), "failure-swallowed": ("109", "fact"), "subject-mocked": ("109", "observation"), "checks-removed": ("109", "fact"), "timer-reassigned": ("113", "fact"),
    "exit-added": ("102", "observation"), "always-equal-added": ("103", "fact"), "replaced-by-stub": ("101", "fact"), "selection-changed": ("109", "fact"),
}


def file_features(files: DataFrame) -> DataFrame:
    """Two rows, old and new, for each Python or pytest configuration file that differs; unchanged ones never reach Python."""
    name = F.element_at(F.split("path", "/"), -1)
    changed = files.where(~F.col("before").eqNullSafe(F.col("after")) & (F.endswith("path", F.lit(".py")) | name.isin(*syntax.CONFIG_FILES)))
    sides = changed.select("change", "path", F.explode(F.array(F.struct(F.lit("old").alias("side"), F.col("before").alias("text")), F.struct(F.lit("new").alias("side"), F.col("after").alias("text")))).alias("s"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([{"change": c, "path": p, "side": s} | syntax.features(p, t) for c, p, s, t in b.itertuples(index=False)], columns=[x.split()[0] for x in FEATURES.split(", ")] if not len(b) else None)

    return dealt_evenly(sides.select("change", "path", "s.side", "s.text")).mapInPandas(run, FEATURES)


def not_checked(features: DataFrame) -> DataFrame:
    """Files of which one side could not be read: listed, never guessed."""
    return features.where("NOT parsed").select("change", "path").distinct()


def _sides(features: DataFrame) -> DataFrame:
    """One row for each file with both sides read."""
    return features.sparkSession.sql(
        """SELECT change, path, max_by(struct(*), 1) FILTER (WHERE side = 'old') AS old, max_by(struct(*), 1) FILTER (WHERE side = 'new') AS new
           FROM {f} GROUP BY change, path HAVING every(parsed)""",
        f=features,
    )


def test_matches(features: DataFrame) -> DataFrame:
    """Every test of the new version with its old self: of the same file, else of the one old test with its name, else of
    the one with its function's name. Several new tests may have one old self."""
    name = F.element_at(F.split("path", "/"), -1)
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    is_test = F.endswith("path", F.lit(".py")) & ((name == "conftest.py") | F.startswith(name, F.lit("test_")) | F.endswith(name, F.lit("_test.py")) | F.arrays_overlap(folders, F.array(F.lit("test"), F.lit("tests"))))
    read = F.every("parsed").over(Window.partitionBy("change", "path"))
    whole = features.where(is_test).select("change", "path", "side", "tests", read.alias("read")).where("read")
    each = whole.select("change", "path", "side", F.explode("tests").alias("t"))
    return features.sparkSession.sql(
        """WITH old AS (SELECT change, path, t FROM {e} WHERE side = 'old'), new AS (SELECT change, path, t FROM {e} WHERE side = 'new'),
        by_name AS (SELECT change, t.name AS name, any_value(t) AS t FROM old GROUP BY 1, 2 HAVING count(*) = 1),
        by_bare AS (SELECT change, t.bare AS bare, any_value(t) AS t FROM old GROUP BY 1, 2 HAVING count(*) = 1)
        SELECT n.change, n.path, coalesce(o.t, a.t, b.t) AS old, n.t AS new FROM new n
        LEFT JOIN old o ON o.change = n.change AND o.path = n.path AND o.t.name = n.t.name
        LEFT JOIN by_name a ON a.change = n.change AND a.name = n.t.name LEFT JOIN by_bare b ON b.change = n.change AND b.bare = n.t.bare""",
        e=read_once(each),
    )


FACT = "array<struct<rule:string,subject:string,line:int,detail:string>>"


def fact(rule: str, when: str, detail: str, subject: str = "''", line: str | None = None) -> str:
    """SQL: an array of the one fact where the condition holds, else of none."""
    line = f"new.first_lines['{rule}']" if line is None else line
    return f"CASE WHEN {when} THEN array(named_struct('rule', '{rule}', 'subject', {subject}, 'line', CAST({line} AS INT), 'detail', CAST({detail} AS STRING))) END"


def every(*arrays: str) -> str:
    """SQL: the facts of all, one row each."""
    return f"inline(flatten(array_compact(array({', '.join(f'CAST({a} AS {FACT})' for a in arrays)}))))"


def more(side: str) -> str:
    return f"new.{side} > old.{side}"


def added(side: str) -> str:
    return f"array_except(new.{side}, old.{side})"


#: Rules about a file's two sides, each an array of facts.
OF_FILES = (
    fact("skips-added", f"is_test AND {more('skips')}", "concat(new.skips - old.skips, ' added')", line="new.first_lines['skips']"),
    fact("conditional-skips-added", f"is_test AND {more('conditional_skips')}", "concat(new.conditional_skips - old.conditional_skips, ' added')", line="new.first_lines['skips']"),
    fact("trivial-checks-added", "is_test AND size(new.trivial) > size(old.trivial)", "concat(size(new.trivial) - size(old.trivial), ' added')"),
    fact("tests-without-checks", "is_test AND size(bare_tests) > 0", "concat(size(bare_tests), ' such as ', bare_tests[0])"),
    fact("report-hook-added", rf"is_test AND regexp_like(path, r'(^|/)conftest\.py$') AND (size({added('hooks')}) > 0 OR (new.patches_reports AND NOT old.patches_reports))", f"array_join({added('hooks')}, ', ')"),
    fact("timer-reassigned", f"python AND size({added('timers')}) > 0", f"array_join({added('timers')}, ', ')"),
    fact("exit-added", f"python AND NOT is_test AND {more('exits')}", "concat(new.exits - old.exits, ' added')"),
    fact("always-equal-added", f"python AND NOT is_test AND {more('always_equal')}", "concat(new.always_equal - old.always_equal, ' added')"),
    fact("replaced-by-stub", "python AND NOT is_test AND old.present AND size(stubbed) > 0", "concat(size(stubbed), ' such as ', stubbed[0])"),
    """CASE WHEN NOT python THEN transform(filter(array_union(map_keys(old.selection), map_keys(new.selection)), k -> NOT (old.selection[k] <=> new.selection[k])),
        k -> named_struct('rule', 'selection-changed', 'subject', k, 'line', 1, 'detail', concat(coalesce(old.selection[k], '(unset)'), ' to ', coalesce(new.selection[k], '(unset)')))) END""",
)
_NAMED = {"subject": "new.name", "line": "new.line"}
#: Rules about a test and its old self, which is null for a new one.
OF_TESTS = (
    fact("check-weakened", "old.strength LIKE 'S%' AND new.strength LIKE 'W%'", "concat(old.strength, ' to ', new.strength)", **_NAMED),
    """CASE WHEN old IS NOT NULL THEN transform(filter(map_keys(new.tolerances), k -> new.tolerances[k] > old.tolerances[k]),
        k -> named_struct('rule', 'tolerance-loosened', 'subject', new.name, 'line', new.line, 'detail', concat(k, ' from ', old.tolerances[k], ' to ', new.tolerances[k]))) END""",
    fact("timeout-raised", "old.timeout > 0 AND new.timeout > old.timeout", "concat(old.timeout, ' to ', new.timeout)", **_NAMED),
    fact("expected-value-changed", "old IS NOT NULL AND other IS NOT NULL", "concat(old.expected[other], ' to ', new.expected[other])", **_NAMED),
    fact("failure-swallowed", "new.swallowed > coalesce(old.swallowed, 0)", "new.swallowed - coalesce(old.swallowed, 0)", **_NAMED),
    fact("subject-mocked", "size(array_except(new.mocked, coalesce(old.mocked, array()))) > 0", "array_except(new.mocked, coalesce(old.mocked, array()))[0]", **_NAMED),
)


def change_facts(files: DataFrame) -> DataFrame:
    """All facts of all changes. Rules about a file or a test are arrays of facts in one projection each."""
    f = read_once(file_features(files))  # the Python stage runs once for all rules
    weakness = "CASE rule " + " ".join(f"WHEN '{k}' THEN 'BGW-{w}'" for k, (w, _) in RULES.items()) + " END"
    kind = "CASE WHEN rule IN (" + ", ".join(f"'{k}'" for k, (_, x) in RULES.items() if x == "observation") + ") THEN 'observation' ELSE 'fact' END"
    is_test = "(path LIKE '%.py' AND (regexp_like(path, r'(^|/)(conftest|test_[^/]*|[^/]*_test)\\.py$') OR regexp_like(path, r'(^|/)tests?/')))"
    return files.sparkSession.sql(
        f"""WITH s AS (SELECT *, {is_test} AS is_test, path LIKE '%.py' AS python FROM {{sides}}),
        t AS (SELECT * FROM s WHERE is_test),
        kept AS (SELECT DISTINCT change, name FROM t LATERAL VIEW explode(new.tests) e AS x LATERAL VIEW explode(array(x.name, x.bare)) n AS name),
        was AS (SELECT change, path, x.name, x.bare FROM t LATERAL VIEW explode(old.tests) e AS x WHERE path NOT LIKE '%conftest.py'),
        lost AS (SELECT w.* FROM was w LEFT ANTI JOIN kept k ON k.change = w.change AND (k.name = w.name) LEFT ANTI JOIN kept b ON b.change = w.change AND b.name = w.bare),
        d AS (SELECT *, array_min(filter(map_keys(new.expected), x -> old.expected[x] <> new.expected[x])) AS other FROM {{m}} WHERE old IS NULL OR old.tree <> new.tree),
        raw AS (
        SELECT change, path, 'tests-removed' AS rule, '' AS subject, CAST(NULL AS INT) AS line, concat(count(*), ' gone, such as ', array_join(slice(array_sort(collect_list(name)), 1, 3), ', ')) AS detail FROM lost GROUP BY change, path
        UNION ALL SELECT change, path, 'checks-removed', '', min(new.line), concat(sum(old.checks - new.checks), ' removed') FROM d WHERE new.checks < old.checks GROUP BY change, path
        UNION ALL SELECT change, path, {every(*OF_FILES)} FROM (SELECT *, array_intersect({added('stubs')}, old.functions) AS stubbed,
            array_sort(transform(filter(new.tests, x -> x.checks = 0 AND NOT exists(old.tests, y -> y.bare = x.bare)), x -> x.name)) AS bare_tests FROM s)
        UNION ALL SELECT change, path, {every(*OF_TESTS)} FROM d)
        SELECT change, rule, {weakness} AS weakness, {kind} AS kind, path, subject, CASE WHEN rule = 'tests-removed' THEN NULL ELSE coalesce(line, 1) END AS line, detail FROM raw""",
        sides=read_once(_sides(f)),
        m=read_once(test_matches(f)),
    )


def to_sarif(facts: DataFrame) -> DataFrame:
    """One SARIF result, as JSON, for each fact, with a fingerprint that its message does not change."""
    from scorewright.functions.ids import fingerprint

    return facts.selectExpr(
        "change",
        f"""to_json(named_struct('ruleId', rule, 'level', CASE kind WHEN 'fact' THEN 'warning' ELSE 'note' END, 'message', named_struct('text', detail),
            'locations', array(named_struct('physicalLocation', named_struct('artifactLocation', named_struct('uri', path), 'region', named_struct('startLine', coalesce(line, 1))))),
            'partialFingerprints', named_struct('fact/v1', {fingerprint('rule', 'path', 'subject')}))) AS result""",
    )
