"""Evaluation statistics and the audit of how scores were aggregated.

rows has line LONG or DECIMAL(38, 0), task_id, model STRING, score DOUBLE or null (errored), max_score DOUBLE, cluster STRING or null,
sample LONG or null. Everything is aggregates over (model, task), then (model, cluster), then model; no step holds a
model's or a cluster's tasks together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from scorewright.functions.intervals import detectable, normal, wilson

FEW_HUNDRED = 300


def task_scores(rows: DataFrame) -> DataFrame:
    """One row for each model and task: the mean with errors as failures, and the mean without them."""
    return rows.sparkSession.sql(
        """SELECT model, task_id, avg(coalesce(score / max_score, 0.0D)) AS value, avg(score / max_score) AS kept,
                  count(*) AS samples, count_if(score IS NULL) AS errored
           FROM {rows} GROUP BY model, task_id""",
        rows=rows,
    )


def clusters(rows: DataFrame) -> DataFrame:
    """The first cluster in file order that a task names, over all models."""
    return rows.sparkSession.sql("SELECT task_id, min_by(cluster, line) AS cluster FROM {rows} WHERE cluster IS NOT NULL GROUP BY task_id", rows=rows)


def _labelled(values: DataFrame, rows: DataFrame) -> DataFrame:
    """values with the label of each task's cluster, its own id where it has none, and whether the file has clusters at all."""
    return values.sparkSession.sql(
        """SELECT v.*, coalesce(c.cluster, v.task_id) AS label, f.clustered
           FROM {values} v LEFT JOIN {named} c ON v.task_id = c.task_id
           CROSS JOIN (SELECT /*+ BROADCAST */ count(cluster) > 0 AS clustered FROM {rows}) f""",
        values=values,
        named=clusters(rows),
        rows=rows,
    )


#: The clustered variance from sums of each cluster: sum over clusters of (S - n mean)**2 less the squared residuals.
_SE = """CASE WHEN n < 2 THEN NULL WHEN clustered THEN
    sqrt(greatest(0.0D, var / n + (ss - 2 * mean * ns + mean * mean * nn - (n - 1) * var) / (CAST(n AS DOUBLE) * n)))
    ELSE sqrt(var / n) END"""


def _spread(values: DataFrame, by: str) -> DataFrame:
    """For each group: n, mean, and the sums that the standard error takes, by way of its clusters."""
    return values.sparkSession.sql(
        f"""WITH c AS (SELECT {by}, label, any_value(clustered) AS clustered, count(*) AS m, sum(value) AS s, sum(kept) AS k, count(kept) AS kn,
                   sum(samples) AS samples, sum(errored) AS errored, every(value IN (0.0D, 1.0D)) AS whole, sum(value * value) AS q
            FROM {{values}} GROUP BY {by}, label),
        a AS (SELECT {by}, any_value(clustered) AS clustered, sum(m) AS n, sum(s) / sum(m) AS mean, sum(k) / nullif(sum(kn), 0) AS kept, sum(samples) AS samples,
                   sum(errored) AS errored, every(whole) AS whole, sum(s) AS total, sum(q) AS q, sum(s * s) AS ss, sum(m * s) AS ns, sum(CAST(m AS DOUBLE) * m) AS nn
            FROM c GROUP BY {by})
        SELECT *, {_SE} AS se FROM (SELECT *, CASE WHEN n > 1 THEN greatest(0.0D, (q - n * mean * mean) / (n - 1)) END AS var FROM a)""",
        values=values,
    )


def model_scores(rows: DataFrame) -> DataFrame:
    """One row for each model: its score, interval, method, standard error and detectable difference."""
    wide = _spread(_labelled(task_scores(rows), rows), "model")
    k, n = "CAST(total AS BIGINT)", "n"
    lo_w, hi_w = wilson(k, n)
    lo_n, hi_n = normal("mean", "se")
    use = "whole AND NOT clustered"
    return wide.selectExpr(
        "model",
        "n AS tasks",
        "samples",
        "errored",
        "mean AS score",
        "CASE WHEN errored > 0 THEN kept END AS score_errors_dropped",
        f"CASE WHEN {use} THEN {lo_w} ELSE {lo_n} END AS low",
        f"CASE WHEN {use} THEN {hi_w} ELSE {hi_n} END AS high",
        f"CASE WHEN {use} THEN 'wilson' WHEN clustered THEN 'normal clustered' ELSE 'normal' END AS method",
        "se AS standard_error",
        f"{detectable('sqrt(2D) * se')} AS detectable",
        f"NOT ({use}) AND n < {FEW_HUNDRED} AS few_tasks",
    )


def comparisons(rows: DataFrame) -> DataFrame:
    """One row for each pair of models, first < second: over shared tasks, difference, interval, detectable difference.

    Pairs without a shared task are rows of nulls with tasks 0. Only the list of models is paired freely; its size
    is the output's.
    """
    values = task_scores(rows)
    spark = rows.sparkSession
    both = spark.sql("SELECT x.model AS first, y.model AS second, x.task_id, x.value - y.value AS value, NULL AS kept, 0 AS samples, 0 AS errored FROM {v} x JOIN {v} y ON x.task_id = y.task_id AND x.model < y.model", v=values)
    spread = _spread(_labelled(both, rows), "first, second")
    lo, hi = normal("s.mean", "s.se")
    return spark.sql(
        f"""SELECT a.model AS first, b.model AS second, coalesce(s.n, 0) AS tasks, s.mean AS difference, {lo} AS low, {hi} AS high, {detectable("s.se")} AS detectable, coalesce({lo} > 0 OR {hi} < 0, false) AS distinguishable
            FROM {{m}} a JOIN {{m}} b ON a.model < b.model LEFT JOIN {{s}} s ON s.first = a.model AND s.second = b.model""",
        m=rows.select("model").distinct(),
        s=spread,
    )


def duplicate_samples(rows: DataFrame) -> DataFrame:
    """Each row that repeats a model, task and sample, null being a sample, with the first line of it."""
    return rows.sparkSession.sql(
        """SELECT model, task_id, sample, first_line, line FROM (
             SELECT model, task_id, sample, line, row_number() OVER w AS nth, first_value(line) OVER w AS first_line
             FROM {rows} WINDOW w AS (PARTITION BY model, task_id, sample ORDER BY line)) WHERE nth > 1""",
        rows=rows,
    )


def missing_tasks(rows: DataFrame) -> DataFrame:
    """For each model without a result on some task that another has: how many, and the first such task."""
    return rows.sparkSession.sql(
        """WITH have AS (SELECT task_id, collect_set(model) AS models FROM {rows} GROUP BY task_id),
        gone AS (SELECT /*+ BROADCAST(every_model) */ task_id, explode(array_except(every_model.models, have.models)) AS model
                 FROM have CROSS JOIN (SELECT collect_set(model) AS models FROM {rows}) every_model)
        SELECT model, count(*) AS missing, min(task_id) AS example FROM gone GROUP BY model""",
        rows=rows,
    )


def score_flags(rows: DataFrame) -> DataFrame:
    """For each model: rows, and those that errored, lie outside 0 to full marks (and the first such line), or are partial credit."""
    return rows.sparkSession.sql(
        """SELECT model, count(*) AS samples, count_if(score IS NULL) AS errored,
                  count_if(score < 0 OR score > max_score) AS outside, min(CASE WHEN score < 0 OR score > max_score THEN line END) AS first_outside,
                  count_if(score > 0 AND score < max_score) AS partial
           FROM {rows} GROUP BY model""",
        rows=rows,
    )


def report_counts(rows: DataFrame) -> DataFrame:
    """Distinct tasks, and distinct clusters among the tasks' first ones."""
    return rows.sparkSession.sql("SELECT (SELECT count(DISTINCT task_id) FROM {rows}) AS tasks, (SELECT count(DISTINCT cluster) FROM {named}) AS clusters", rows=rows, named=clusters(rows))


def findings(rows: DataFrame, min_difference: float | None = None) -> DataFrame:
    """Every finding: weakness, kind, model, and the numbers it states; too-small evaluations only against min_difference."""
    need = "CAST(NULL AS DOUBLE)" if min_difference is None else f"{min_difference!r}D"
    return rows.sparkSession.sql(
        f"""SELECT 'BGW-128' AS weakness, 'duplicate-sample' AS kind, model, CAST(NULL AS STRING) AS other, task_id AS subject, CAST(line AS DOUBLE) AS amount FROM {{duplicates}}
        UNION ALL SELECT 'BGW-128', 'outside-range', model, NULL, CAST(first_outside AS STRING), outside FROM {{flags}} WHERE outside > 0
        UNION ALL SELECT 'BGW-122', 'partial-credit', model, NULL, NULL, partial FROM {{flags}} WHERE partial > 0
        UNION ALL SELECT 'BGW-128', 'missing-tasks', model, NULL, example, missing FROM {{missing}}
        UNION ALL SELECT 'BGW-128', 'errored-samples', model, NULL, NULL, errored FROM {{flags}} WHERE errored > 0
        UNION ALL SELECT 'BGW-133', 'too-small', model, NULL, NULL, detectable FROM {{models}} WHERE detectable > {need} AND (SELECT count(*) FROM {{models}}) = 1
        UNION ALL SELECT 'BGW-133', 'too-small-pair', first, second, NULL, detectable FROM {{pairs}} WHERE detectable > {need}""",
        duplicates=duplicate_samples(rows),
        flags=score_flags(rows),
        missing=missing_tasks(rows),
        models=model_scores(rows),
        pairs=comparisons(rows),
    )
