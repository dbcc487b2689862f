"""Precision and recall of a checking tool from the fate of its findings and from planted weaknesses."""

from __future__ import annotations

from pyspark.sql import DataFrame

from scorewright.functions.intervals import wilson

# The words of a finding's fate.
LEVELS = ("proven", "proven-experimental")
OUTCOMES = ("stands", "disputed", "withdrawn-after-dispute", "contradicted-by-fixture")
FALSE = ("withdrawn-after-dispute", "contradicted-by-fixture")


def precision(outcomes: DataFrame, level: str = "proven") -> DataFrame:
    """For each battery (probe null) and each of its probes: false, resolved, disputed, dismissed and reported
    findings of the level, the rate per thousand with its interval, and the share dismissed. A dispute counts neither way."""
    low, high = wilson("n_false", "resolved")
    return outcomes.sparkSession.sql(
        f"""WITH g AS (SELECT battery, probe, count_if(outcome IN {FALSE}) AS n_false, count_if(outcome <> 'disputed') AS resolved,
               count_if(outcome = 'disputed') AS disputed, count_if(dismissed) AS dismissed, count(*) AS reported
            FROM {{o}} WHERE level = '{level}' GROUP BY GROUPING SETS ((battery), (battery, probe)))
        SELECT *, 1000.0D * n_false / nullif(resolved, 0) AS per_thousand, 1000 * {low} AS low, 1000 * {high} AS high, dismissed / nullif(CAST(reported AS DOUBLE), 0) AS dismissal_rate FROM g""",
        o=outcomes,
    )


def recall(planted: DataFrame) -> DataFrame:
    """For each weakness, by number: planted, tried, accepted, proven and the interval of each share. An instance listed
    twice for a weakness is an error."""
    bounds = ", ".join(f"{w} AS {s}_{b}" for s in ("tried", "accepted", "proven") for b, w in zip(("low", "high"), wilson(s, "planted"), strict=True))
    return planted.sparkSession.sql(
        f"""WITH once AS (SELECT weakness, instance, first(tried) AS tried, first(accepted) AS accepted, first(proven) AS proven,
               CASE WHEN count(*) > 1 THEN raise_error(concat(instance, ' is listed twice for ', weakness)) END AS clash
            FROM {{p}} GROUP BY weakness, instance),
        g AS (SELECT weakness, count(*) AS planted, count_if(tried) AS tried, count_if(accepted) AS accepted, count_if(proven) AS proven, max(clash) AS clash FROM once GROUP BY weakness)
        SELECT weakness, CAST(substring(weakness, 5) AS INT) AS number, planted, tried, accepted, proven, {bounds} FROM g WHERE clash IS NULL ORDER BY number""",
        p=planted,
    )


def maturity(rates: DataFrame) -> DataFrame:
    """A probe is stable with no false accusation and a lower bound on precision of 95 % or more."""
    low, _ = wilson("resolved - n_false", "resolved")
    return rates.selectExpr("battery", "probe", f"n_false = 0 AND coalesce({low} >= 0.95D, false) AS stable")


def with_decisions(findings: DataFrame, decisions: DataFrame) -> DataFrame:
    """findings with outcome and dismissed as the active decisions leave them: ignore hides and dismisses, dispute
    stays visible and counts neither way."""
    return findings.sparkSession.sql(
        """SELECT f.* EXCEPT (outcome, dismissed), CASE WHEN d.action = 'dispute' THEN 'disputed' ELSE f.outcome END AS outcome,
                  f.dismissed OR coalesce(d.action = 'ignore', false) AS dismissed, NOT coalesce(d.action = 'ignore', false) AS visible
           FROM {f} f LEFT JOIN {d} d ON f.finding = d.finding""",
        f=findings,
        d=decisions,
    )
