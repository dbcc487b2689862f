"""The record tables that the queries read, as views over the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One SELECT for each view. All of it is plain SQL that either engine reads, so views never differ between the two.
VIEWS = {
    "v_results": """SELECT ((l_orderkey * 100000 + l_partkey) * 1000 + l_suppkey % 1000) * 100000 + CAST(round(l_extendedprice * 100) AS BIGINT) % 100000 AS line, CAST(l_orderkey AS VARCHAR(20)) AS task_id, l_returnflag AS model,
        CASE WHEN l_tax = 0.08 THEN NULL ELSE l_discount * 10 END AS score, CAST(1.0 AS DOUBLE) AS max_score,
        CASE WHEN l_suppkey % 7 = 0 THEN NULL ELSE CAST(l_suppkey AS VARCHAR(20)) END AS cluster, CAST(l_linenumber AS BIGINT) AS sample FROM lineitem""",
    "v_results_bin": """SELECT doc_id AS line, CAST(doc_id AS VARCHAR(20)) AS task_id, 'quality' AS model, CAST(quality AS DOUBLE) AS score, CAST(1.0 AS DOUBLE) AS max_score,
        CAST(NULL AS VARCHAR(20)) AS cluster, CAST(0 AS BIGINT) AS sample FROM labels
        UNION ALL SELECT doc_id, CAST(doc_id AS VARCHAR(20)), 'toxic', CAST(toxic AS DOUBLE), CAST(1.0 AS DOUBLE), CAST(NULL AS VARCHAR(20)), CAST(0 AS BIGINT) FROM labels""",
    "v_outcomes": """SELECT CAST(event_id AS VARCHAR(20)) AS finding, event_type AS probe, user_id % 3 + 1 AS battery, CASE WHEN event_id % 11 = 0 THEN 'proven-experimental' ELSE 'proven' END AS level,
        CASE WHEN value < 60 THEN 'stands' WHEN value < 90 THEN 'disputed' WHEN value < 150 THEN 'withdrawn-after-dispute' ELSE 'contradicted-by-fixture' END AS outcome, event_id % 13 = 0 AS dismissed FROM events""",
    "v_planted": """SELECT 'BGW-' || CAST(p_size AS VARCHAR(20)) AS weakness, CAST(p_partkey AS VARCHAR(20)) AS instance, p_partkey % 10 < 8 AS tried, p_partkey % 10 < 5 AS accepted, p_partkey % 10 < 2 AS proven FROM part""",
    "v_tasks": """SELECT CAST(c_custkey AS VARCHAR(20)) AS task_id, c_custkey AS ordinal, CASE c_custkey % 8 WHEN 0 THEN 'program' WHEN 1 THEN 'io' WHEN 2 THEN 'workspace' WHEN 3 THEN 'container'
        WHEN 4 THEN 'history' WHEN 5 THEN 'numeric' WHEN 6 THEN 'proof' ELSE 'query' END AS shape FROM customer""",
    "v_attempts": """SELECT CAST(o_custkey AS VARCHAR(20)) AS task_id, o_orderpriority AS operator, o_orderkey % 9 <> 0 AS known_wrong,
        CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS accepted, o_totalprice > 495000 AS scale_exceeded FROM orders WHERE o_orderkey % 2 = 0""",
    "v_controls": """SELECT CAST(o_custkey AS VARCHAR(20)) AS task_id, CASE month(o_orderdate) % 4 WHEN 0 THEN 'oracle' WHEN 1 THEN 'reformatted' WHEN 2 THEN 'comment_free' ELSE 'renamed_locals' END AS relation,
        month(o_orderdate) % 4 = 0 AS baseline, CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN o_orderkey % 3 <> 0 END AS accepted, o_totalprice > 497000 AS scale_exceeded, o_orderkey AS ordinal
        FROM orders WHERE o_orderkey % 2 = 1""",
    "v_categories": """SELECT operator, category FROM (VALUES ('1-URGENT', 'hollow_program'), ('2-HIGH', 'harness_tampering'), ('3-MEDIUM', 'weak_tests'), ('4-NOT SPECIFIED', '')) AS t(operator, category)""",
    "v_checks": """SELECT CAST(user_id AS VARCHAR(20)) AS task, CASE event_type WHEN 'click' THEN 'weak_oracle' WHEN 'view' THEN 'determinism' WHEN 'purchase' THEN 'ground_truth_rejected'
        WHEN 'signup' THEN 'answer_leakage' ELSE 'other' END AS kind, CASE WHEN event_id % 5 = 0 THEN 'error' ELSE 'ok' END AS status, value / 500 AS sub_score, event_id FROM events""",
    "v_runs": """SELECT CAST(user_id AS VARCHAR(20)) AS task_id, event_type AS submission, CASE WHEN value < 150 THEN CAST(1.0 AS DOUBLE) ELSE CAST(0.0 AS DOUBLE) END AS reward FROM events""",
    "v_commits": """SELECT CAST(conv_id AS VARCHAR(20)) || '-' || CAST(turn AS VARCHAR(20)) AS id, CASE WHEN conv_id % 3 = 0 THEN 'Fix ' WHEN conv_id % 7 = 0 THEN 'Note: all tests pass. ' ELSE '' END || text AS message FROM conversations""",
    "v_fixtures": """SELECT 'f' || CAST(p_partkey AS VARCHAR(20)) AS id, 'BGW-' || CAST(p_partkey - p_partkey % 2 AS VARCHAR(20)) AS weakness, p_partkey % 2 = 0 AS defect, p_partkey AS n FROM part""",
    "v_findings": """SELECT CAST(o_orderkey AS VARCHAR(20)) AS finding, CAST(o_custkey AS VARCHAR(20)) AS task_id, o_orderpriority AS probe, 'sub' || CAST(o_orderkey % 5 AS VARCHAR(20)) AS submission,
        CASE WHEN o_orderkey % 4 = 0 THEN 'lead' ELSE 'proven' END AS level FROM orders""",
    "v_repro": """SELECT CAST(l_orderkey AS VARCHAR(20)) AS finding, l_linenumber AS n, l_quantity > 5 AS passed, l_discount < 0.09 AS baseline_passed FROM lineitem""",
    "v_decisions": """SELECT CAST(o_orderkey AS VARCHAR(20)) AS finding, CASE WHEN o_orderkey % 3 = 0 THEN 'ignore' ELSE 'dispute' END AS action,
        CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS expires FROM orders WHERE o_orderkey % 10 = 0""",
    "v_records": """SELECT CAST(o_orderkey AS VARCHAR(20)) AS record, CASE WHEN o_orderstatus = 'F' THEN 'fixed' ELSE 'open' END AS status, o_orderdate AS notified,
        o_orderdate + INTERVAL 1 DAY * CAST(o_orderkey % 90 - 5 AS INT) AS published, o_orderkey % 2 = 0 AS agreed_early FROM orders""",
}
#: Spark reads this key wider: line numbers made of it pass BIGINT from 922,338 orders on, where the SQL itself stops.
WIDE = {"v_results": ("l_orderkey * 100000", "CAST(l_orderkey AS DECIMAL(19, 0)) * 100000")}
SOURCES = "region nation customer supplier part orders lineitem events documents labels benchmark conversations".split()


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The view as a DataFrame; only the tables that it names are read, and Catalyst prunes their columns."""
    sql = VIEWS[name].replace(*WIDE.get(name, ("", "")))
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in SOURCES if f"FROM {t}" in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
    return spark.sql(sql, **used) if used else spark.sql(sql)


def numbered(df: DataFrame, rows: DataFrame, *lines: str) -> DataFrame:
    """df, made of rows, with its line numbers as BIGINT, as the SQL has them; where a line of rows passes that, all stay DECIMAL(38, 0)."""
    if rows.selectExpr("max(abs(line)) > 9223372036854775807").first()[0]:
        return df
    return df.withColumns({c: F.col(c).cast("bigint") for c in lines})


def views(spark: SparkSession, sf_dir: str, *names: str) -> list[DataFrame]:
    return [view(spark, sf_dir, n) for n in names]


def duck(*names: str) -> str:
    """The same views as common table expressions."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
