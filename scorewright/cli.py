"""python -m scorewright.cli power FILE | verify REPO | conformance SUITE FILE, and what extensions add.

0 clean, 1 findings, 2 unreadable, 3 sign-in needed, 4 out of credit, 64 wrong use.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from scorewright import plugins

OK, FOUND, UNREADABLE, SIGN_IN, NO_CREDIT, USAGE = 0, 1, 2, 3, 4, 64


class Command:
    """A subcommand of another package: its class stands under the entry points of plugins.COMMANDS."""

    name = ""
    help = ""

    def configure(self, parser: argparse.ArgumentParser) -> None:
        pass

    def run(self, spark: SparkSession, args: argparse.Namespace) -> int:
        raise NotImplementedError


def power(spark: SparkSession, a: argparse.Namespace) -> int:
    from scorewright.plans.reports import power_report, power_text
    from scorewright.sources.strict import RESULTS, read_sound

    rows = read_sound(spark, a.file, RESULTS).persist()  # a report reads them some ten times
    try:
        report = power_report(rows, a.file, a.min_difference)
    finally:
        rows.unpersist()
    print(json.dumps(report) if a.json else power_text(report))
    return FOUND if report["findings"] else OK


def verify(spark: SparkSession, a: argparse.Namespace) -> int:
    from scorewright.operators.change_facts import change_facts
    from scorewright.plans.reports import sarif, verify_report, verify_text
    from scorewright.sources.git import GitChange, default_base, messages, resolve

    spark.dataSource.register(GitChange)
    base = resolve(a.repo, a.since) if a.since else default_base(a.repo)
    files = spark.read.format("git_change").options(repo=a.repo, since=base).load().persist()
    try:
        report = verify_report(files, a.since, base, messages(a.repo, base))
        print(sarif(change_facts(files.where("fault IS NULL")), "scorewright") if a.sarif else json.dumps(report) if a.json else verify_text(report))
    finally:
        files.unpersist()
    return FOUND if any(f["kind"] == "fact" for f in report["facts"]) and (a.strict or report["success_claims"]) else OK


def conformance(spark: SparkSession, a: argparse.Namespace) -> int:
    from scorewright.operators.evidence import conformance_outcomes, conformance_rates
    from scorewright.plans.reports import conformance_report, conformance_text
    from scorewright.sources.dimensions import fixtures
    from scorewright.sources.documents import conformance_results

    results = conformance_results(spark, Path(a.file).read_text())
    first = results.select("level", "version", "tool", "tool_version").first()
    head = first.asDict() if first else {}
    suite = fixtures(spark, Path(a.suite).read_text(), head.get("level"))
    report = conformance_report(conformance_outcomes(suite, results), conformance_rates(suite, results), head)
    print(json.dumps(report) if a.json else conformance_text(report))
    return OK if report["achieved"] else FOUND


def main(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="scorewright", exit_on_error=False)
    sub = p.add_subparsers(dest="command", required=True)
    one = sub.add_parser("power")
    one.add_argument("file")
    one.add_argument("--json", action="store_true")
    one.add_argument("--min-difference", type=float)
    two = sub.add_parser("verify")
    two.add_argument("repo")
    two.add_argument("--since")
    two.add_argument("--strict", action="store_true")
    two.add_argument("--sarif", action="store_true")
    two.add_argument("--json", action="store_true")
    three = sub.add_parser("conformance")
    three.add_argument("suite")
    three.add_argument("file")
    three.add_argument("--json", action="store_true")
    own = {"power": power, "verify": verify, "conformance": conformance}
    for name, kind in plugins.load(plugins.COMMANDS, base=Command).items():
        more = kind()
        if (more.name or name) not in own:
            more.configure(sub.add_parser(more.name or name, help=more.help))
            own[more.name or name] = more.run
    try:
        a = p.parse_args(args)
    except (argparse.ArgumentError, SystemExit) as x:
        print(x, file=sys.stderr)
        return USAGE
    spark = SparkSession.builder.appName("scorewright").getOrCreate()
    try:
        return own[a.command](spark, a)
    except (ValueError, KeyError, OSError) as x:
        print(x, file=sys.stderr)
        return UNREADABLE


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
