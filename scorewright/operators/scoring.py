"""Scoring a grader: coverage of wrong submissions, acceptance of correct ones, exclusions, scorecard and gap.

attempts: task_id, operator, known_wrong, accepted (null: could not run), scale_exceeded. controls: task_id, relation,
baseline, accepted, scale_exceeded, ordinal. tasks: task_id, shape, ordinal.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from scorewright.functions.intervals import wilson

CATEGORIES = ("hollow_program", "harness_tampering", "answer_access", "weak_tests", "grader_logic")
SHAPES = ("program", "io", "workspace", "container", "history", "numeric", "proof", "query")
WEIGHTS = {"weak_oracle": 1.0, "determinism": 1.0, "ground_truth_rejected": 0.0, "answer_leakage": 0.0}
FAMILIES = {"weak_oracle": "acceptance", "determinism": "reliability", "ground_truth_rejected": "rejection", "answer_leakage": "task_validity"}
DEFAULT_WEIGHT = 1.0


def _rates(measured: DataFrame, key: str, hit: str, sets: str, order: str) -> DataFrame:
    low, high = wilson(hit, "measured")
    return measured.sparkSession.sql(
        f"""WITH g AS (SELECT {key}, count_if(ok) AS {hit}, count(*) AS measured FROM {{m}} GROUP BY GROUPING SETS {sets})
        SELECT *, 100.0D * {hit} / nullif(measured, 0) AS score, {low} AS low, {high} AS high FROM g ORDER BY {order}""",
        m=measured,
    )


def coverage_pairs(attempts: DataFrame, categories: DataFrame, past_full_marks: DataFrame | None = None) -> DataFrame:
    """One row for each task and category measured: ok where no wrong submission got through. Leads, attempts that could
    not run, and tasks on which the grader paid past full marks count neither way."""
    past = attempts.where("scale_exceeded").select("task_id").distinct() if past_full_marks is None else past_full_marks
    return attempts.sparkSession.sql(
        """SELECT a.task_id, coalesce(nullif(c.category, ''), 'other') AS category, NOT bool_or(a.accepted) AS ok
           FROM {a} a LEFT JOIN {c} c ON a.operator = c.operator
           WHERE a.known_wrong AND a.accepted IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {p} p WHERE p.task_id = a.task_id)
           GROUP BY 1, 2""",
        a=attempts,
        c=categories,
        p=past,
    )


def coverage(attempts: DataFrame, categories: DataFrame) -> DataFrame:
    """Caught of measured for each category and (category null) over all, in the published order, then by name."""
    rank = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CATEGORIES))
    return _rates(coverage_pairs(attempts, categories), "category", "caught", "((category), ())", f"CASE category {rank} ELSE 99 END, category")


def accepted_baselines(controls: DataFrame) -> DataFrame:
    """Tasks whose baseline ran and was never rejected."""
    return controls.sparkSession.sql("SELECT task_id FROM {c} WHERE baseline AND accepted IS NOT NULL GROUP BY task_id HAVING bool_and(accepted)", c=controls)


def acceptance_pairs(controls: DataFrame) -> DataFrame:
    """One row for each task and relation measured: ok where every try was accepted; only tasks with an accepted baseline."""
    return controls.sparkSession.sql(
        """SELECT c.task_id, c.relation, bool_and(c.accepted) AS ok, min(c.ordinal) AS ordinal FROM {c} c LEFT SEMI JOIN {b} b ON b.task_id = c.task_id
           WHERE NOT c.baseline AND c.accepted IS NOT NULL GROUP BY 1, 2""",
        c=controls,
        b=accepted_baselines(controls),
    )


def acceptance(controls: DataFrame) -> DataFrame:
    """Accepted of measured for each relation, first seen first, and (relation null) over all."""
    low, high = wilson("accepted", "measured")
    return controls.sparkSession.sql(
        f"""WITH g AS (SELECT relation, count_if(ok) AS accepted, count(*) AS measured, min(ordinal) AS first_seen FROM {{m}} GROUP BY GROUPING SETS ((relation), ()))
        SELECT relation, accepted, measured, 100.0D * accepted / nullif(measured, 0) AS score, {low} AS low, {high} AS high FROM g ORDER BY relation IS NULL, first_seen""",
        m=acceptance_pairs(controls),
    )


def exclusions(tasks: DataFrame, attempts: DataFrame, controls: DataFrame) -> DataFrame:
    """Tasks left out of the scorecard and why: a rejected baseline goes before a score past full marks."""
    return tasks.sparkSession.sql(
        """WITH why AS (SELECT task_id, 1 AS rank FROM {c} WHERE baseline AND NOT accepted
                UNION ALL SELECT task_id, 2 FROM {a} WHERE scale_exceeded UNION ALL SELECT task_id, 2 FROM {c} WHERE scale_exceeded),
        one AS (SELECT task_id, min(rank) AS rank FROM why GROUP BY task_id)
        SELECT t.task_id, t.shape, CASE rank WHEN 1 THEN 'baseline-rejected' ELSE 'past-full-marks' END AS reason FROM {t} t JOIN one USING (task_id) ORDER BY t.ordinal""",
        t=tasks,
        a=attempts,
        c=controls,
    )


def scorecard(tasks: DataFrame, attempts: DataFrame, controls: DataFrame, categories: DataFrame) -> DataFrame:
    """For each shape and (shape null) over all, after exclusions: tasks, untried, caught, measured, coverage, accepted,
    tested, acceptance. A task tried is one with a result of a grounded submission."""
    out = exclusions(tasks, attempts, controls).select("task_id")
    keep = lambda df: df.join(out, "task_id", "left_anti")
    a, c = keep(attempts), keep(controls)
    return tasks.sparkSession.sql(
        """WITH tried AS (SELECT DISTINCT task_id FROM {a} WHERE known_wrong AND accepted IS NOT NULL),
        cov AS (SELECT task_id, count(*) AS m, count_if(ok) AS k FROM {cov} GROUP BY task_id),
        acc AS (SELECT task_id, count(*) AS m, count_if(ok) AS k FROM {acc} GROUP BY task_id),
        t AS (SELECT t.shape, tried.task_id IS NULL AS untried, cov.m AS cm, cov.k AS ck, acc.m AS am, acc.k AS ak
              FROM {t} t LEFT JOIN tried USING (task_id) LEFT JOIN cov USING (task_id) LEFT JOIN acc USING (task_id)),
        g AS (SELECT shape, count(*) AS tasks, count_if(untried) AS untried, coalesce(sum(ck), 0) AS caught, coalesce(sum(cm), 0) AS measured,
              coalesce(sum(ak), 0) AS accepted, coalesce(sum(am), 0) AS tested FROM t GROUP BY GROUPING SETS ((shape), ()))
        SELECT *, 100.0D * caught / nullif(measured, 0) AS coverage, 100.0D * accepted / nullif(tested, 0) AS acceptance FROM g""",
        t=keep(tasks),
        a=a,
        cov=coverage_pairs(a, categories),
        acc=acceptance_pairs(c),
    )


def weaknesses_run(attempts: DataFrame, controls: DataFrame, manifests: DataFrame, tasks: DataFrame, active: DataFrame) -> DataFrame:
    """For each shape: the weaknesses that probes with a counted result name, and the active ones of the shape not among them.

    manifests: operator, weakness (array). active: weakness, shapes (array).
    """
    return attempts.sparkSession.sql(
        """WITH used AS (SELECT DISTINCT task_id, operator FROM {a} WHERE known_wrong AND accepted IS NOT NULL
              UNION SELECT task_id, relation FROM {c} c WHERE accepted IS NOT NULL AND (baseline OR EXISTS (SELECT 1 FROM {b} b WHERE b.task_id = c.task_id))),
        m AS (SELECT DISTINCT t.shape, w.weakness FROM used u JOIN {t} t USING (task_id) JOIN (SELECT operator, explode(weakness) AS weakness FROM {p}) w USING (operator)),
        s AS (SELECT DISTINCT shape FROM {t}),
        n AS (SELECT s.shape, w.weakness FROM s JOIN (SELECT weakness, explode(shapes) AS shape FROM {w}) w ON w.shape = s.shape LEFT ANTI JOIN m ON m.shape = s.shape AND m.weakness = w.weakness)
        SELECT shape, weakness, 'measured' AS standing FROM m UNION ALL SELECT shape, weakness, 'not-run' FROM n""",
        a=attempts,
        c=controls,
        b=accepted_baselines(controls),
        t=tasks,
        p=manifests,
        w=active,
    )


def verification_gap(results: DataFrame) -> DataFrame:
    """results: group, check, status, sub_score -> for each group the weighted mean of completed checks times 100 (null
    where no weight was measured), the checks measured, and their number in all."""
    weight = "CASE check " + " ".join(f"WHEN '{k}' THEN {v}D" for k, v in WEIGHTS.items()) + f" ELSE {DEFAULT_WEIGHT}D END"
    return results.sparkSession.sql(
        f"""SELECT `group`, 100 * sum(CASE WHEN done THEN w * sub_score END) / nullif(sum(CASE WHEN done THEN w END), 0) AS score,
               array_join(array_sort(collect_list(CASE WHEN done THEN check END)), ',') AS measured, count(*) AS total
            FROM (SELECT *, status = 'ok' AND sub_score IS NOT NULL AS done, {weight} AS w FROM {{r}}) GROUP BY `group`""",
        r=results,
    )


def gap_sides(results: DataFrame) -> DataFrame:
    """The unweighted mean of each side's completed checks, times 100; a side without any check has no row."""
    family = "CASE check " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FAMILIES.items()) + " END"
    return results.sparkSession.sql(
        f"""SELECT `group`, side, 100 * avg(CASE WHEN status = 'ok' THEN sub_score END) AS score,
               array_join(array_sort(collect_list(CASE WHEN status = 'ok' AND sub_score IS NOT NULL THEN check END)), ',') AS checks
            FROM (SELECT *, {family} AS side FROM {{r}}) WHERE side IN ('acceptance', 'rejection') GROUP BY `group`, side""",
        r=results,
    )


def unknown_tasks(tasks: DataFrame, *others: DataFrame) -> DataFrame:
    """Task ids that attempts or controls name and tasks does not have, and ids that tasks has twice; empty where all is well."""
    twice = tasks.groupBy("task_id").count().where("count > 1").selectExpr("task_id", "'duplicate' AS problem")
    for o in others:
        twice = twice.union(o.select("task_id").distinct().join(tasks, "task_id", "left_anti").selectExpr("task_id", "'unknown' AS problem"))
    return twice.distinct()
