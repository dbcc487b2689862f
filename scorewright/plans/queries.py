"""Every relational query of the library with its SQL for an independent engine, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.functions import ids
from scorewright.functions.intervals import Z_95, Z_POWER
from scorewright.operators import error_rates, evidence, power, scoring

from .views import duck, numbered, view, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
Z, MDE = Z_95, Z_95 + Z_POWER


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def query(name: str, oracle: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return keep


def wilson(k: str, n: str, scale: str = "1") -> tuple[str, str]:
    """The textbook form, for the other engine."""
    mid, half = f"(({k}) + {Z * Z / 2}) / (({n}) + {Z * Z})", f"{Z} * sqrt(({k})::DOUBLE * (({n}) - ({k})) / ({n}) + {Z * Z / 4}) / (({n}) + {Z * Z})"
    low = f"round({scale} * CASE WHEN ({n}) = 0 THEN NULL WHEN ({k}) = 0 THEN 0 ELSE {mid} - {half} END, 6)::DOUBLE"
    return low, f"round({scale} * CASE WHEN ({n}) = 0 THEN NULL WHEN ({k}) = ({n}) THEN 1 ELSE {mid} + {half} END, 6)::DOUBLE"


# --- statistics of an evaluation

_TASKS = """t AS (SELECT model, task_id, avg(coalesce(score / max_score, 0)) AS v, avg(score / max_score) AS kept, count(*) AS samples, count(*) FILTER (score IS NULL) AS errored FROM r GROUP BY ALL),
c AS (SELECT task_id, arg_min(cluster, line) AS cluster FROM r WHERE cluster IS NOT NULL GROUP BY task_id),
f AS (SELECT count(*) > 0 AS clustered FROM c)"""


def _models(name: str) -> str:
    lo, hi = wilson("sum(v)::BIGINT", "count(*)")
    return f"""{duck(name)}, r AS (SELECT * FROM {name}), {_TASKS},
    l AS (SELECT t.*, coalesce(c.cluster, t.task_id) AS label, clustered FROM t LEFT JOIN c USING (task_id) CROSS JOIN f),
    m AS (SELECT model, avg(v) AS mu FROM l GROUP BY model),
    e AS (SELECT l.*, v - mu AS d FROM l JOIN m USING (model)),
    x AS (SELECT model, sum(s * s - q) AS cross_ FROM (SELECT model, label, sum(d) AS s, sum(d * d) AS q FROM e GROUP BY ALL) GROUP BY model),
    g AS (SELECT model, count(*)::BIGINT AS tasks, sum(samples)::BIGINT AS samples, sum(errored)::BIGINT AS errored, avg(v) AS mean, avg(kept) AS kept, any_value(clustered) AS clustered,
                 bool_and(v IN (0, 1)) AS whole, CASE WHEN count(*) > 1 THEN var_samp(v) / count(*) END AS var, {lo} AS wl, {hi} AS wh FROM l GROUP BY model),
    s AS (SELECT *, sqrt(greatest(0, var + CASE WHEN clustered THEN cross_ / (tasks::DOUBLE * tasks) ELSE 0 END)) AS se FROM g JOIN x USING (model))
    SELECT model, tasks, samples, errored, round(mean, 6) AS score, round(CASE WHEN errored > 0 THEN kept END, 6) AS score_errors_dropped,
           CASE WHEN whole AND NOT clustered THEN wl ELSE round(mean - {Z} * se, 6) END AS low, CASE WHEN whole AND NOT clustered THEN wh ELSE round(mean + {Z} * se, 6) END AS high,
           CASE WHEN whole AND NOT clustered THEN 'wilson' WHEN clustered THEN 'normal clustered' ELSE 'normal' END AS method,
           round(se, 6) AS standard_error, round({MDE} * sqrt(2) * se, 6) AS detectable, NOT (whole AND NOT clustered) AND tasks < 300 AS few_tasks FROM s"""


@query("power_model_scores", _models("v_results"))
def power_model_scores(spark, sf_dir):
    return rounded(power.model_scores(view(spark, sf_dir, "v_results")))


@query("power_wilson", _models("v_results_bin"))
def power_wilson(spark, sf_dir):
    return rounded(power.model_scores(view(spark, sf_dir, "v_results_bin")))


@query("power_task_scores", f"{duck('v_results')}, r AS (SELECT * FROM v_results), {_TASKS} SELECT model, task_id, round(v, 6) AS value, round(kept, 6) AS kept, samples, errored FROM t")
def power_task_scores(spark, sf_dir):
    return rounded(power.task_scores(view(spark, sf_dir, "v_results")))


_PAIRS = f"""{duck("v_results")}, r AS (SELECT * FROM v_results), {_TASKS},
d AS (SELECT a.model AS first, b.model AS second, a.task_id, a.v - b.v AS v, coalesce(c.cluster, a.task_id) AS label FROM t a JOIN t b ON a.task_id = b.task_id AND a.model < b.model LEFT JOIN c ON c.task_id = a.task_id),
m AS (SELECT first, second, avg(v) AS mu, count(*) AS n, CASE WHEN count(*) > 1 THEN var_samp(v) END AS var FROM d GROUP BY ALL),
x AS (SELECT first, second, sum(s * s - q) AS cross_ FROM (SELECT first, second, label, sum(v - mu) AS s, sum((v - mu) * (v - mu)) AS q FROM d JOIN m USING (first, second) GROUP BY ALL) GROUP BY ALL),
s AS (SELECT *, sqrt(greatest(0, var / n + CASE WHEN clustered THEN cross_ / (n::DOUBLE * n) ELSE 0 END)) AS se FROM m JOIN x USING (first, second) CROSS JOIN f),
k AS (SELECT DISTINCT model FROM r)
SELECT a.model AS first, b.model AS second, coalesce(s.n, 0)::BIGINT AS tasks, round(mu, 6) AS difference, round(mu - {Z} * se, 6) AS low, round(mu + {Z} * se, 6) AS high, round({MDE} * se, 6) AS detectable, coalesce(mu - {Z} * se > 0 OR mu + {Z} * se < 0, FALSE) AS distinguishable
FROM k a JOIN k b ON a.model < b.model LEFT JOIN s ON s.first = a.model AND s.second = b.model"""


@query("power_pairs", _PAIRS)
def power_pairs(spark, sf_dir):
    return rounded(power.comparisons(view(spark, sf_dir, "v_results")))


@query(
    "power_missing",
    f"""{duck("v_results")}, m AS (SELECT DISTINCT model FROM v_results), t AS (SELECT DISTINCT task_id FROM v_results), h AS (SELECT DISTINCT model, task_id FROM v_results)
    SELECT m.model, count(*)::BIGINT AS missing, min(t.task_id) AS example FROM m CROSS JOIN t ANTI JOIN h ON h.model = m.model AND h.task_id = t.task_id GROUP BY m.model""",
)
def power_missing(spark, sf_dir):
    return power.missing_tasks(view(spark, sf_dir, "v_results"))


@query(
    "power_duplicates",
    f"""{duck("v_results")}, w AS (SELECT *, min(line) OVER (PARTITION BY model, task_id, sample) AS first_line FROM v_results) SELECT model, task_id, sample, first_line, line FROM w WHERE line > first_line""",
)
def power_duplicates(spark, sf_dir):
    rows = view(spark, sf_dir, "v_results")
    return numbered(power.duplicate_samples(rows), rows, "first_line", "line")


def _flags(scale: str) -> str:
    return f"""{duck("v_results")}, r AS (SELECT * REPLACE (score * {scale} AS score) FROM v_results)
    SELECT model, count(*)::BIGINT AS samples, count(*) FILTER (score IS NULL)::BIGINT AS errored, count(*) FILTER (score NOT BETWEEN 0 AND max_score)::BIGINT AS outside,
           min(line) FILTER (score NOT BETWEEN 0 AND max_score) AS first_outside, count(*) FILTER (score > 0 AND score < max_score)::BIGINT AS partial FROM r GROUP BY model"""


@query("power_flags", _flags("1.0"))
def power_flags(spark, sf_dir):
    rows = view(spark, sf_dir, "v_results")
    return numbered(power.score_flags(rows), rows, "first_outside")


@query("power_outside", _flags("1.2"))
def power_outside(spark, sf_dir):
    rows = view(spark, sf_dir, "v_results")
    return numbered(power.score_flags(rows.withColumn("score", F.col("score") * 1.2)), rows, "first_outside")


@query(
    "power_counts",
    f"""{duck("v_results")}, r AS (SELECT * FROM v_results), {_TASKS} SELECT (SELECT count(DISTINCT task_id) FROM r)::BIGINT AS tasks, (SELECT count(DISTINCT cluster) FROM c)::BIGINT AS clusters""",
)
def power_counts(spark, sf_dir):
    return power.report_counts(view(spark, sf_dir, "v_results"))


@query("power_findings", f"""WITH p AS ({_PAIRS}), fl AS ({_flags('1.0')}), dup AS ({ORACLE_SQL['power_duplicates']}), mi AS ({ORACLE_SQL['power_missing']})
SELECT kind, count(*)::BIGINT AS n FROM (SELECT 'duplicate-sample' AS kind FROM dup UNION ALL SELECT 'partial-credit' FROM fl WHERE partial > 0 UNION ALL SELECT 'outside-range' FROM fl WHERE outside > 0
  UNION ALL SELECT 'errored-samples' FROM fl WHERE errored > 0 UNION ALL SELECT 'missing-tasks' FROM mi UNION ALL SELECT 'too-small-pair' FROM p WHERE detectable > 0.001) GROUP BY kind""")
def power_findings(spark, sf_dir):
    return power.findings(view(spark, sf_dir, "v_results"), 0.001).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


# --- error rates

_FALSE = "outcome IN ('withdrawn-after-dispute', 'contradicted-by-fixture')"
_PRECISION = f"""SELECT battery, probe, count(*) FILTER ({_FALSE})::BIGINT AS n_false, count(*) FILTER (outcome <> 'disputed')::BIGINT AS resolved, count(*) FILTER (outcome = 'disputed')::BIGINT AS disputed,
    count(*) FILTER (dismissed)::BIGINT AS dismissed, count(*)::BIGINT AS reported FROM v_outcomes WHERE level = 'proven' GROUP BY GROUPING SETS ((battery), (battery, probe))"""


@query(
    "error_precision",
    f"""{duck("v_outcomes")}, g AS ({_PRECISION}) SELECT *, round(1000.0 * n_false / nullif(resolved, 0), 6)::DOUBLE AS per_thousand, {wilson('n_false', "resolved", "1000")[0]} AS low, {wilson('n_false', "resolved", "1000")[1]} AS high,
    round(dismissed::DOUBLE / nullif(reported, 0), 6) AS dismissal_rate FROM g""",
)
def error_precision(spark, sf_dir):
    return rounded(error_rates.precision(view(spark, sf_dir, "v_outcomes")))


@query("error_maturity", f"""{duck("v_outcomes")}, g AS ({_PRECISION}) SELECT battery, probe, n_false = 0 AND coalesce({wilson('resolved - n_false', "resolved")[0]} >= 0.95, FALSE) AS stable FROM g""")
def error_maturity(spark, sf_dir):
    return error_rates.maturity(error_rates.precision(view(spark, sf_dir, "v_outcomes")))


@query(
    "error_recall",
    f"""{duck("v_planted")}, g AS (SELECT weakness, count(*)::BIGINT AS planted, count(*) FILTER (tried)::BIGINT AS tried, count(*) FILTER (accepted)::BIGINT AS accepted, count(*) FILTER (proven)::BIGINT AS proven FROM v_planted GROUP BY weakness)
    SELECT weakness, substr(weakness, 5)::INT AS number, planted, tried, accepted, proven, """
    + ", ".join(f"{w} AS {s}_{b}" for s in ("tried", "accepted", "proven") for b, w in zip(("low", "high"), wilson(s, "planted"), strict=True))
    + " FROM g",
)
def error_recall(spark, sf_dir):
    return rounded(error_rates.recall(view(spark, sf_dir, "v_planted")))


@query(
    "error_decisions",
    f"""{duck("v_outcomes", "v_decisions")} SELECT o.finding, o.probe, o.battery, o.level, CASE WHEN d.action = 'dispute' THEN 'disputed' ELSE o.outcome END AS outcome,
    o.dismissed OR coalesce(d.action = 'ignore', FALSE) AS dismissed, coalesce(d.action, '') <> 'ignore' AS visible FROM v_outcomes o LEFT JOIN v_decisions d USING (finding)""",
)
def error_decisions(spark, sf_dir):
    return error_rates.with_decisions(*views(spark, sf_dir, "v_outcomes", "v_decisions"))


# --- scoring

_COV = """cov AS (SELECT a.task_id, coalesce(nullif(k.category, ''), 'other') AS category, NOT bool_or(a.accepted) AS ok FROM {a} a LEFT JOIN v_categories k USING (operator)
    WHERE known_wrong AND accepted IS NOT NULL AND a.task_id NOT IN (SELECT task_id FROM {a} WHERE scale_exceeded) GROUP BY ALL)"""
_ACC = """base AS (SELECT task_id FROM {c} WHERE baseline AND accepted IS NOT NULL GROUP BY task_id HAVING bool_and(accepted)),
acc AS (SELECT task_id, relation, bool_and(accepted) AS ok FROM {c} WHERE NOT baseline AND accepted IS NOT NULL AND task_id IN (SELECT task_id FROM base) GROUP BY ALL)"""


@query(
    "coverage_by_category",
    f"""{duck("v_attempts", "v_categories")}, {_COV.format(a="v_attempts")}, g AS (SELECT category, count(*) FILTER (ok)::BIGINT AS caught, count(*)::BIGINT AS measured FROM cov GROUP BY GROUPING SETS ((category), ()))
    SELECT *, round(100.0 * caught / nullif(measured, 0), 6)::DOUBLE AS score, {wilson("caught", "measured")[0]} AS low, {wilson("caught", "measured")[1]} AS high FROM g""",
)
def coverage_by_category(spark, sf_dir):
    return rounded(scoring.coverage(*views(spark, sf_dir, "v_attempts", "v_categories")))


@query(
    "acceptance_by_relation",
    f"""{duck("v_controls")}, {_ACC.format(c="v_controls")}, g AS (SELECT relation, count(*) FILTER (ok)::BIGINT AS accepted, count(*)::BIGINT AS measured FROM acc GROUP BY GROUPING SETS ((relation), ()))
    SELECT *, round(100.0 * accepted / nullif(measured, 0), 6)::DOUBLE AS score, {wilson("accepted", "measured")[0]} AS low, {wilson("accepted", "measured")[1]} AS high FROM g""",
)
def acceptance_by_relation(spark, sf_dir):
    return rounded(scoring.acceptance(view(spark, sf_dir, "v_controls")))


_EXCL = """excl AS (SELECT task_id, CASE WHEN bool_or(rejected) THEN 'baseline-rejected' ELSE 'past-full-marks' END AS reason FROM (
    SELECT task_id, TRUE AS rejected FROM v_controls WHERE baseline AND accepted = FALSE UNION ALL SELECT task_id, FALSE FROM v_controls WHERE scale_exceeded
    UNION ALL SELECT task_id, FALSE FROM v_attempts WHERE scale_exceeded) GROUP BY task_id)"""


@query("scorecard_exclusions", f"""{duck("v_tasks", "v_attempts", "v_controls")}, {_EXCL} SELECT task_id, shape, reason FROM v_tasks JOIN excl USING (task_id)""")
def scorecard_exclusions(spark, sf_dir):
    return scoring.exclusions(*views(spark, sf_dir, "v_tasks", "v_attempts", "v_controls"))


_KEPT = f"{_EXCL}, t AS (SELECT * FROM v_tasks ANTI JOIN excl USING (task_id)), a AS (SELECT * FROM v_attempts ANTI JOIN excl USING (task_id)), c AS (SELECT * FROM v_controls ANTI JOIN excl USING (task_id))"


@query(
    "scorecard_shapes",
    f"""{duck("v_tasks", "v_attempts", "v_controls", "v_categories")}, {_KEPT}, {_COV.format(a="a")}, {_ACC.format(c="c")},
    s AS (SELECT shape FROM (SELECT DISTINCT shape FROM t) UNION ALL SELECT NULL),
    one AS (SELECT s.shape, (SELECT count(*) FROM t WHERE s.shape IS NULL OR t.shape = s.shape)::BIGINT AS tasks,
      (SELECT count(*) FROM t WHERE (s.shape IS NULL OR t.shape = s.shape) AND task_id NOT IN (SELECT task_id FROM a WHERE known_wrong AND accepted IS NOT NULL))::BIGINT AS untried,
      (SELECT count(*) FILTER (ok) FROM cov JOIN t USING (task_id) WHERE s.shape IS NULL OR t.shape = s.shape)::BIGINT AS caught, (SELECT count(*) FROM cov JOIN t USING (task_id) WHERE s.shape IS NULL OR t.shape = s.shape)::BIGINT AS measured,
      (SELECT count(*) FILTER (ok) FROM acc JOIN t USING (task_id) WHERE s.shape IS NULL OR t.shape = s.shape)::BIGINT AS accepted, (SELECT count(*) FROM acc JOIN t USING (task_id) WHERE s.shape IS NULL OR t.shape = s.shape)::BIGINT AS tested FROM s)
    SELECT *, round(100.0 * caught / nullif(measured, 0), 6)::DOUBLE AS coverage, round(100.0 * accepted / nullif(tested, 0), 6)::DOUBLE AS acceptance FROM one""",
)
def scorecard_shapes(spark, sf_dir):
    return rounded(scoring.scorecard(*views(spark, sf_dir, "v_tasks", "v_attempts", "v_controls", "v_categories")))


_MANIFESTS = [("1-URGENT", "101"), ("2-HIGH", "108"), ("3-MEDIUM", "101"), ("3-MEDIUM", "126"), ("oracle", "124"), ("reformatted", "120")]
_ACTIVE = [("101", "program"), ("102", "program"), ("108", "workspace"), ("108", "history"), ("120", "program"), ("124", "io"), ("126", "program"), ("134", "proof")]


@query(
    "scorecard_not_run",
    f"""{duck("v_tasks", "v_attempts", "v_controls")}, {_ACC.format(c="v_controls")},
    man AS (SELECT operator, 'BGW-' || n AS weakness FROM (VALUES {", ".join(map(str, _MANIFESTS))}) AS x(operator, n)), act AS (SELECT 'BGW-' || n AS weakness, shape FROM (VALUES {", ".join(map(str, _ACTIVE))}) AS x(n, shape)),
    used AS (SELECT task_id, operator FROM v_attempts WHERE known_wrong AND accepted IS NOT NULL UNION SELECT task_id, relation FROM v_controls WHERE accepted IS NOT NULL AND (baseline OR task_id IN (SELECT task_id FROM base))),
    m AS (SELECT DISTINCT shape, weakness FROM used JOIN v_tasks USING (task_id) JOIN man USING (operator))
    SELECT shape, weakness, 'measured' AS standing FROM m UNION ALL SELECT shape, weakness, 'not-run' FROM act ANTI JOIN m USING (shape, weakness)""",
)
def scorecard_not_run(spark, sf_dir):
    group = lambda rows, key, item: [(k, sorted(x[item] for x in rows if x[key] == k)) for k in dict.fromkeys(x[key] for x in rows)]
    manifests = spark.createDataFrame([(k, [f"BGW-{n}" for n in v]) for k, v in group(_MANIFESTS, 0, 1)], "operator string, weakness array<string>")
    active = spark.createDataFrame([(f"BGW-{k}", v) for k, v in group(_ACTIVE, 0, 1)], "weakness string, shapes array<string>")
    tasks, attempts, controls = views(spark, sf_dir, "v_tasks", "v_attempts", "v_controls")
    return scoring.weaknesses_run(attempts, controls, manifests, tasks, active)


_CHECKS = "checks AS (SELECT task AS \"group\", kind, min(status) AS status, avg(sub_score) AS sub_score FROM v_checks GROUP BY task, kind)"


def _checks(spark, sf_dir):
    return view(spark, sf_dir, "v_checks").groupBy(F.col("task").alias("group"), F.col("kind").alias("check")).agg(F.min("status").alias("status"), F.avg("sub_score").alias("sub_score"))


@query(
    "verification_gap",
    f"""{duck("v_checks")}, {_CHECKS}, w AS (SELECT *, CASE WHEN kind IN ('ground_truth_rejected', 'answer_leakage') THEN 0.0 ELSE 1.0 END AS weight, status = 'ok' AND sub_score IS NOT NULL AS done FROM checks)
    SELECT "group", round(100 * sum(weight * sub_score) FILTER (done) / nullif(sum(weight) FILTER (done), 0), 6)::DOUBLE AS score, coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (done), '') AS measured, count(*)::BIGINT AS total FROM w GROUP BY "group\"""",
)
def verification_gap(spark, sf_dir):
    return rounded(scoring.verification_gap(_checks(spark, sf_dir)))


@query(
    "gap_sides",
    f"""{duck("v_checks")}, {_CHECKS}, w AS (SELECT *, CASE kind WHEN 'weak_oracle' THEN 'acceptance' WHEN 'ground_truth_rejected' THEN 'rejection' END AS side, status = 'ok' AND sub_score IS NOT NULL AS done FROM checks)
    SELECT "group", side, round(100 * avg(sub_score) FILTER (done), 6)::DOUBLE AS score, coalesce(string_agg(kind, ',' ORDER BY kind) FILTER (done), '') AS checks FROM w WHERE side IS NOT NULL GROUP BY "group", side""",
)
def gap_sides(spark, sf_dir):
    return rounded(scoring.gap_sides(_checks(spark, sf_dir)))


@query(
    "unknown_tasks",
    f"""{duck("v_tasks", "v_attempts")} SELECT DISTINCT task_id, 'unknown' AS problem FROM v_attempts WHERE task_id NOT IN (SELECT task_id FROM v_tasks WHERE ordinal % 5 <> 0)""",
)
def unknown_tasks(spark, sf_dir):
    tasks, attempts = views(spark, sf_dir, "v_tasks", "v_attempts")
    return scoring.unknown_tasks(tasks.where("ordinal % 5 <> 0"), attempts)


# --- evidence

_RESULTS = """res AS (SELECT id AS fixture, CASE WHEN n % 17 = 0 THEN 'error' ELSE 'ran' END AS status,
    CASE WHEN n % 10 = 0 THEN [weakness, 'BGW-1'] WHEN defect AND n % 3 <> 0 THEN [weakness] WHEN NOT defect AND n % 7 = 0 THEN ['BGW-2'] ELSE []::VARCHAR[] END AS flagged FROM v_fixtures WHERE n % 23 <> 0)"""


def _conformance(spark, sf_dir):
    fixtures = view(spark, sf_dir, "v_fixtures")
    results = fixtures.where("n % 23 <> 0").selectExpr(
        "id AS fixture",
        "CASE WHEN n % 17 = 0 THEN 'error' ELSE 'ran' END AS status",
        "CASE WHEN n % 10 = 0 THEN array(weakness, 'BGW-1') WHEN defect AND n % 3 <> 0 THEN array(weakness) WHEN NOT defect AND n % 7 = 0 THEN array('BGW-2') ELSE CAST(array() AS ARRAY<STRING>) END AS flagged",
    )
    return fixtures.select("id", "weakness", "defect"), results


_JOINED = f"{duck('v_fixtures')}, {_RESULTS}, j AS (SELECT f.*, CASE WHEN status = 'ran' THEN flagged END AS flagged FROM v_fixtures f LEFT JOIN res ON fixture = id)"


@query(
    "conformance_outcomes",
    f"""{_JOINED}, g AS (SELECT weakness, coalesce(bool_and(coalesce(list_contains(flagged, weakness), FALSE)) FILTER (defect), TRUE) AS detected, coalesce(bool_and(coalesce(len(flagged) = 0, FALSE)) FILTER (NOT defect), TRUE) AS clean,
      coalesce(string_agg(CASE WHEN list_contains(flagged, 'BGW-1') THEN 'BGW-1' END, ',') FILTER (defect), '') AS misattributed, coalesce(string_agg(CASE WHEN flagged IS NULL THEN id END, ',' ORDER BY id), '') AS not_run FROM j GROUP BY weakness)
    SELECT *, detected AND clean AND misattributed = '' AND not_run = '' AS passed FROM g""",
)
def conformance_outcomes(spark, sf_dir):
    out = evidence.conformance_outcomes(*_conformance(spark, sf_dir))
    return out.withColumns({c: F.array_join(c, ",") for c in ("misattributed", "not_run")})


@query(
    "conformance_youden",
    f"""{_JOINED}, g AS (SELECT count(*) FILTER (defect AND list_contains(flagged, weakness))::BIGINT AS true_positives, count(*) FILTER (defect)::BIGINT AS defective, count(*) FILTER (NOT defect AND len(flagged) > 0)::BIGINT AS false_positives, count(*) FILTER (NOT defect)::BIGINT AS correct FROM j)
    SELECT *, round(true_positives::DOUBLE / defective - false_positives::DOUBLE / correct, 6) AS youden FROM g""",
)
def conformance_youden(spark, sf_dir):
    return rounded(evidence.conformance_rates(*_conformance(spark, sf_dir)))


_JUDGED = """judged AS (SELECT finding, CASE WHEN count(*) < 3 THEN 'error' WHEN NOT bool_or(baseline_passed) THEN 'baseline-failed' WHEN count(DISTINCT baseline_passed) > 1 OR count(DISTINCT passed) > 1 THEN 'flaky'
    WHEN bool_and(passed) THEN 'reproduced' ELSE 'not-reproduced' END AS outcome FROM v_repro GROUP BY finding)"""


def _reproductions(spark, sf_dir):
    runs = view(spark, sf_dir, "v_repro").groupBy("finding").agg(F.collect_list("passed").alias("runs"), F.collect_list("baseline_passed").alias("baseline"))
    return evidence.judge(runs.withColumn("error", F.lit("")))


@query("repro_judge", f"{duck('v_repro')}, {_JUDGED} SELECT finding, outcome FROM judged")
def repro_judge(spark, sf_dir):
    return _reproductions(spark, sf_dir).select("finding", "outcome")


@query(
    "repro_apply",
    f"""{duck("v_repro", "v_findings")}, {_JUDGED}, r AS (SELECT finding, outcome, 'sub' || CAST(CAST(finding AS BIGINT) % 4 AS VARCHAR) AS submission FROM judged)
    SELECT f.finding, f.submission, CASE WHEN r.finding IS NULL OR r.submission <> f.submission OR level <> 'proven' OR outcome = 'reproduced' THEN level WHEN outcome IN ('flaky', 'not-reproduced') THEN 'lead' ELSE 'excluded' END AS level,
      outcome, coalesce(r.submission <> f.submission, FALSE) AS wrong_submission FROM v_findings f LEFT JOIN r USING (finding)""",
)
def repro_apply(spark, sf_dir):
    results = _reproductions(spark, sf_dir).selectExpr("finding", "outcome", "concat('sub', CAST(CAST(finding AS BIGINT) % 4 AS STRING)) AS submission")
    return evidence.apply_reproductions(view(spark, sf_dir, "v_findings"), results)


@query(
    "weakness_attribution",
    f"""{duck("v_findings", "v_attempts")}, rej AS (SELECT DISTINCT task_id FROM v_attempts WHERE accepted = FALSE AND operator = '1-URGENT')
    SELECT finding, task_id, probe, CASE WHEN probe = '3-MEDIUM' AND task_id IN (SELECT task_id FROM rej) THEN 'BGW-126' ELSE 'BGW-101' END AS weakness FROM v_findings WHERE probe IN ('1-URGENT', '3-MEDIUM')""",
)
def weakness_attribution(spark, sf_dir):
    findings, attempts = views(spark, sf_dir, "v_findings", "v_attempts")
    manifests = spark.createDataFrame([("1-URGENT", ["BGW-101"], []), ("3-MEDIUM", ["BGW-101", "BGW-126"], [("BGW-126", "1-URGENT")])], "probe string, weakness array<string>, rules array<struct<weakness:string,when_rejected:string>>")
    return evidence.attribute(findings, manifests, attempts.where("accepted = false").selectExpr("task_id", "operator AS probe"))


@query("decisions_active", f"{duck('v_decisions')} SELECT finding, action, CAST(expires AS VARCHAR) AS expires FROM v_decisions WHERE expires IS NULL OR expires > DATE '1996-06-01'")
def decisions_active(spark, sf_dir):
    return evidence.active_decisions(view(spark, sf_dir, "v_decisions"), "1996-06-01").withColumn("expires", F.col("expires").cast("string"))


@query(
    "registry_notice",
    f"""{duck("v_records")} SELECT record, CASE WHEN published < notified THEN 'before-notice' ELSE 'too-early' END AS problem FROM v_records WHERE published < notified OR (published < notified + INTERVAL 45 DAY AND NOT (status = 'fixed' AND agreed_early))""",
)
def registry_notice(spark, sf_dir):
    return evidence.notice_problems(view(spark, sf_dir, "v_records"))


@query(
    "determinism_flakes",
    f"""{duck("v_runs")} SELECT task_id, submission, count(*)::BIGINT AS repeats, max(reward) - min(reward) AS spread, max(reward) - min(reward) > 1e-9 AS differs, round(1 - power(0.1, count(*)) - power(0.9, count(*)), 6) AS power FROM v_runs GROUP BY ALL HAVING count(*) > 1""",
)
def determinism_flakes(spark, sf_dir):
    return rounded(evidence.flakes(view(spark, sf_dir, "v_runs")).selectExpr("*", f"{evidence.detection_power('repeats', '0.1D')} AS power"))


@query(
    "grader_disruptions",
    """WITH a AS (SELECT CAST(user_id AS VARCHAR) AS task_id, CAST(event_id AS VARCHAR) AS submission, CASE event_type WHEN 'error' THEN 'crash' WHEN 'signup' THEN 'unknown' ELSE 'scored' END AS status FROM events)
    SELECT * FROM a WHERE status = 'crash' AND task_id IN (SELECT task_id FROM a WHERE status = 'scored')""",
)
def grader_disruptions(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return evidence.disruptions(events.selectExpr("CAST(user_id AS STRING) AS task_id", "CAST(event_id AS STRING) AS submission", "CASE event_type WHEN 'error' THEN 'crash' WHEN 'signup' THEN 'unknown' ELSE 'scored' END AS status"))


@query(
    "answer_leakage",
    r"""WITH tasks AS (SELECT doc_id AS task_id, text AS prompt, CASE WHEN doc_id % 3 = 0 THEN array_to_string(string_split(text, ' ')[3:7], ' ') ELSE b.t END AS reference FROM documents d
      LEFT JOIN (SELECT item_id, text AS t FROM benchmark) b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
    n AS (SELECT task_id, trim(regexp_replace(replace(lower(prompt), 'ß', 'ss'), '\s+', ' ', 'g')) AS p, trim(regexp_replace(replace(lower(coalesce(reference, '')), 'ß', 'ss'), '\s+', ' ', 'g')) AS r FROM tasks)
    SELECT task_id, r AS reference FROM n WHERE contains(' ' || p || ' ', ' ' || r || ' ') AND p <> r AND length(regexp_replace(r, '[^\p{L}\p{N}]', '', 'g')) >= 4
      AND NOT EXISTS (SELECT 1 FROM n o WHERE o.task_id <> n.task_id AND o.r <> n.r AND contains(' ' || o.p || ' ', ' ' || n.r || ' '))""",
)
def answer_leakage(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    n = bench.agg(F.count(F.lit(1)).alias("n"))
    tasks = docs.crossJoin(F.broadcast(n)).join(bench.select("item_id", F.col("text").alias("answer")), F.expr("item_id = doc_id % n"), "left")
    return evidence.answers_in_prompts(tasks.selectExpr("doc_id AS task_id", "text AS prompt", "CASE WHEN doc_id % 3 = 0 THEN array_join(slice(split(text, ' '), 3, 5), ' ') ELSE answer END AS reference"))


# --- identifiers and text


@query(
    "finding_ids",
    """WITH j AS (SELECT o_orderkey, '["' || o_orderpriority || '","' || o_custkey || '","fp",{"kind":"source","sha256":"sha256:' || sha256(o_orderstatus) || '"}]' AS canonical FROM orders),
    b AS (SELECT o_orderkey, CAST('0x' || substr(sha256(canonical), 1, 14) AS BIGINT) >> 6 AS bits FROM j)
    SELECT o_orderkey, 'BF-' || """
    + " || ".join(f"substr('{ids.CROCKFORD}', CAST((bits >> {s}) & 31 AS INT) + 1, 1)" for s in range(45, -1, -5))
    + " AS finding FROM b",
)
def finding_ids(spark, sf_dir):
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = f"concat('[', {ids.json_string('o_orderpriority')}, ',', {ids.json_string('CAST(o_custkey AS STRING)')}, ',\"fp\",{{\"kind\":\"source\",\"sha256\":\"', {ids.digest('o_orderstatus')}, '\"}}]')"
    return orders.selectExpr("o_orderkey", f"{text} AS canonical").selectExpr("o_orderkey", f"{ids.finding_id('canonical')} AS finding")


@query("digests", "SELECT doc_id, 'sha256:' || sha256(text) AS digest FROM documents")
def digests(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id", f"{ids.digest('text')} AS digest")


@query("fact_fingerprints", "SELECT o_orderkey, left(sha256(o_orderpriority || chr(0) || o_orderstatus || chr(0) || CAST(o_custkey AS VARCHAR)), 32) AS fingerprint FROM orders")
def fact_fingerprints(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey", f"{ids.fingerprint('o_orderpriority', 'o_orderstatus', 'CAST(o_custkey AS STRING)')} AS fingerprint")


_TYPED = "CASE part.p_partkey % 4 WHEN 0 THEN 'bf-o' WHEN 1 THEN ' BF-L' WHEN 2 THEN 'Bf-i-' ELSE 'XX-' END || right('000000000' || CAST(p_partkey AS VARCHAR(20)), 9)"


@query("normalised_ids", f"""WITH u AS (SELECT p_partkey, upper(trim({_TYPED})) AS t FROM part), b AS (SELECT p_partkey, t, 'BF-' || translate(replace(substr(t, 4), '-', ''), 'ILO', '110') AS v FROM u)
SELECT p_partkey, CASE WHEN starts_with(t, 'BF-') AND regexp_full_match(v, '{ids.PATTERNS["finding"]}') THEN v END AS finding FROM b""")
def normalised_ids(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return part.selectExpr("p_partkey", f"{_TYPED.replace('part.', '')} AS typed").selectExpr("p_partkey", f"{ids.normalise_finding_id('typed')} AS finding")


_IDS = "CASE p_partkey % 6 WHEN 0 THEN 'BGW-' || p_size WHEN 1 THEN 'BVR-2024-' || (10000 + p_partkey) WHEN 2 THEN 'ab-c/d@' || p_size WHEN 3 THEN 'BF-0123456789' WHEN 4 THEN 'BCL-' || (p_size % 6) ELSE 'BGW-1' || chr(10) END"


@query("id_predicates", f"WITH t AS (SELECT p_partkey, {_IDS} AS id FROM part) SELECT p_partkey, " + ", ".join(f"regexp_full_match(id, '{p}') AS is_{k}" for k, p in ids.PATTERNS.items()) + " FROM t")
def id_predicates(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet").selectExpr("p_partkey", f"{_IDS} AS id")
    return part.selectExpr("p_partkey", *(f"{ids.is_id(k, 'id')} AS is_{k}" for k in ids.PATTERNS))


_MARKED = "CASE WHEN conv_id % 5 = 0 THEN 'I’m SORRY. ' WHEN conv_id % 7 = 0 THEN 'We cannot assist. ' ELSE '' END || text"


@query("refusal_flags", f"SELECT conv_id, turn, regexp_matches(replace(lower({_MARKED}), '’', ''''), '" + "|".join(m.replace("'", "''") for m in ids.REFUSALS) + "') AS refuses FROM conversations")
def refusal_flags(spark, sf_dir):
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").selectExpr("conv_id", "turn", f"{_MARKED} AS message")
    return talk.selectExpr("conv_id", "turn", f"{ids.refusal('message')} AS refuses")


@query("success_claims", f"""{duck("v_commits")} SELECT id, regexp_matches(split_part(message, chr(10), 1), '(?i)^\\W*(fix(es|ed)?|resolve[sd]?|close[sd]?|implement(s|ed)?|complete[sd]?|finish(es|ed)?|done)\\b')
    OR regexp_matches(message, '(?i)\\b(all (the )?tests (now )?pass(es|ing)?|tests (now )?pass(ing)?)\\b') AS claims FROM v_commits""")
def success_claims(spark, sf_dir):
    return view(spark, sf_dir, "v_commits").selectExpr("id", f"{ids.success_claim('message')} AS claims")


from . import code_queries  # noqa: E402, F401  registers its queries
