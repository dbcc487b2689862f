"""Reports as JSON and text. Each renders a result that is small by construction: models, pairs, probes, shapes."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame

from scorewright.operators import power


def tidy(v):
    """Numbers at six decimals; what is not a number is null."""
    if isinstance(v, float):
        return round(v, 6) if math.isfinite(v) else None
    return v


def records(df: DataFrame, *order: str) -> list[dict]:
    return [{k: tidy(v) for k, v in r.asDict(recursive=True).items()} for r in (df.orderBy(*order) if order else df).collect()]


def power_report(rows: DataFrame, source: str = "", min_difference: float | None = None) -> dict:
    found = records(power.findings(rows, min_difference).groupBy("weakness", "kind", "model", "other").count(), "kind", "model", "other")
    counts = records(power.report_counts(rows))[0]
    drop = lambda d: {k: v for k, v in d.items() if v is not None}
    return {"source": source, **counts, "models": records(power.model_scores(rows), "model"), "comparisons": records(power.comparisons(rows).where("tasks > 0"), "first", "second"), "findings": [drop(f) for f in found]}


def percent(v: float | None) -> str:
    return "-" if v is None else f"{100 * v:.1f}"


def power_text(report: dict) -> str:
    lines = [f"{report['tasks']} tasks, {report['clusters']} clusters"]
    for m in report["models"]:
        lines.append(f"{m['model']}: {percent(m['score'])} [{percent(m['low'])}, {percent(m['high'])}] ({m['method']}), detects {percent(m['detectable'])} points")
    for c in report["comparisons"]:
        lines.append(f"{c['first']} - {c['second']}: {percent(c['difference'])} [{percent(c['low'])}, {percent(c['high'])}] over {c['tasks']} tasks")
    worst = max((m["detectable"] for m in report["models"] if m["detectable"] is not None), default=None)
    lines.append("too small to detect any difference" if worst is not None and worst >= 1 else f"detects differences from {percent(worst)} points")
    return "\n".join([*lines, *(f"{f['weakness']} {f['kind']} {f['model']}: {f['count']}" for f in report["findings"])])


SARIF = "https://json.schemastore.org/sarif-2.1.0.json"


def sarif(facts: DataFrame, tool: str, decisions: dict[str, tuple[str, str]] | None = None) -> str:
    """One run with a rule table and a result for each fact; decisions are (action, reason) by fingerprint."""
    from scorewright.operators.change_facts import RULES, to_sarif

    results = [json.loads(r.result) for r in to_sarif(facts).orderBy("result").collect()]
    for r in results:
        print_ = r["partialFingerprints"]["fact/v1"]
        if decisions and print_ in decisions:
            r["suppressions"] = [suppression(*decisions[print_])]
    rules = [{"id": k, "properties": {"tags": [f"BGW-{w}", kind]}, "defaultConfiguration": {"level": "warning" if kind == "fact" else "note"}} for k, (w, kind) in sorted(RULES.items())]
    return json.dumps({"$schema": SARIF, "version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": results}]})


def count(n: int, word: str) -> str:
    return f"{n} {word}" + ("" if n == 1 else "s")


def span(low: float | None, high: float | None, unit: str = "") -> str:
    return "" if low is None or high is None else f" ({low:.0f}–{high:.0f}{unit})"


def error_rate_text(precisions: DataFrame, recalls: DataFrame | None = None) -> str:
    """Rates of false accusation and of recall, each with its sample and interval, and what counted neither way."""
    lines = []
    for p in records(precisions, "battery", "probe"):
        rate = "no resolved finding yet" if p["per_thousand"] is None else f"{p['per_thousand']:.0f} false accusations per 1,000 (95% CI {p['low']:.0f}–{p['high']:.0f}), {p['n_false']} of {p['resolved']}"
        more = f"; {p['disputed']} under open dispute, counted neither way" if p["disputed"] else ""
        more += f"; dismissed {p['dismissed']} of {p['reported']}" if p["reported"] else ""
        lines.append(f"  battery {p['battery']} · {p['probe'] or 'every probe'}: {rate}{more}")
    for r in records(recalls, "number") if recalls is not None else ():
        stages = " · ".join(f"{s} {r[s]}" + span(*(None if r[f"{s}_{b}"] is None else 100 * r[f"{s}_{b}"] for b in ("low", "high")), "%") for s in ("tried", "accepted", "proven"))
        lines.append(f"  {r['weakness']}: {r['planted']} planted · {stages}")
    return "\n".join(lines)


def scorecard_text(card: DataFrame, excluded: DataFrame) -> str:
    """A block for each shape, one for all unless there is exactly one shape, and every task left out with its reason."""
    from scorewright.operators.scoring import SHAPES

    rows = sorted(records(card), key=lambda r: (r["shape"] is None, SHAPES.index(r["shape"]) if r["shape"] else 0))
    if len(rows) == 2:
        rows = rows[:1]
    lines = []
    for r in rows:
        tried = f"; nothing tried on {r['untried']} of them" if r["untried"] else ""
        lines.append(f"{r['shape'] or 'overall'}: {count(r['tasks'], 'task')} scored{tried}")
        for name, score, hit, of, word in (("COVERAGE SCORE", r["coverage"], r["caught"], r["measured"], "caught"), ("CORRECT-WORK ACCEPTANCE", r["acceptance"], r["accepted"], r["tested"], "accepted")):
            lines.append(f"  {name}: not measured" if score is None else f"  {name}: {score:.0f} / 100   {hit} of {of} {word}")
    why = {"baseline-rejected": "its own reference was rejected", "past-full-marks": "the grader paid past full marks"}
    return "\n".join([*lines, *(f"not measured: {e['task_id']} ({e['shape']}): {why[e['reason']]}" for e in records(excluded, "task_id"))])


def conformance_report(outcomes: DataFrame, rates: DataFrame, head: dict) -> dict:
    each = records(outcomes, "weakness")
    each.sort(key=lambda o: int(o["weakness"].rpartition("-")[2]))
    return head | {"achieved": all(o["passed"] for o in each), "outcomes": each} | records(rates)[0]


def conformance_text(report: dict) -> str:
    each = report["outcomes"]
    accused = sum((not o["clean"]) + bool(o["misattributed"]) for o in each)
    verdict = "achieved: every defect was flagged, and no correct grader was" if report["achieved"] else f"not achieved: {count(sum(not o['detected'] for o in each), 'defect')} missed, {count(accused, 'false accusation')}"
    lines = [f"{report.get('tool', '')} {report.get('tool_version', '')} · {report.get('level', '')} version {report.get('version', '')}", "", f"  {verdict}.", f"  Score {100 * report['youden']:.0f}: {report['true_positives']} of {report['defective']} defects flagged, {report['false_positives']} of {report['correct']} correct graders flagged.", ""]
    for o in each:
        why = [*(["defect not flagged"] * (not o["detected"])), *(["correct grader flagged"] * (not o["clean"])), *([f"also flagged {', '.join(o['misattributed'])}"] * bool(o["misattributed"])), *([f"did not run: {', '.join(o['not_run'])}"] * bool(o["not_run"]))]
        lines.append(f"  {o['weakness']:<8} {'passed' if o['passed'] else 'FAILED'}   {'; '.join(why)}".rstrip())
    return "\n".join(lines)


def verify_text(report: dict) -> str:
    facts, claims = report["facts"], report["success_claims"]
    hard = sum(f["kind"] == "fact" for f in facts)
    said = f"{count(hard, 'fact')} and {count(len(facts) - hard, 'observation')} about this change" + (f", beside {count(len(claims), 'commit message')} claiming success" if claims else "")
    lines = [f"since {report['since']} ({report['base'][:7]}) · {count(report['files_changed'], 'file')} changed · {count(report['commits'], 'commit')}", "", f"  {said if facts else 'Nothing in this change weakens tests or code in the ways that are checked'}.", ""]
    lines += [f"  {f['weakness']}  {f['kind']:<11}  {f['rule']} in {f['path']}: {f['detail']}" for f in facts]
    lines += ["", "  Commit messages that claim success:", *(f"    {c['commit']}  {c['message']}" for c in claims)] if facts and claims else []
    return "\n".join([*lines, "", "  Not checked: " + "; ".join(report["not_checked"]) + "."])


NOT_CHECKED = ("a test's expected value copied into the source", "files other than Python and pytest configuration")


def verify_report(files: DataFrame, since: str | None, base: str, messages: list[tuple[str, str]]) -> dict:
    """files: change, path, before, after, fault."""
    from scorewright.functions.ids import success_claim
    from scorewright.operators.change_facts import change_facts, file_features, not_checked

    sound = files.where("fault IS NULL")
    facts = records(change_facts(sound), "kind", "path", "rule", "subject")
    unread = [f"{r.path} (not UTF-8, too large or unreadable)" for r in files.where("fault IS NOT NULL").orderBy("path").collect()]
    unread += [f"{r.path} (does not parse)" for r in not_checked(file_features(sound)).orderBy("path").collect()]
    log = files.sparkSession.createDataFrame(messages, "commit string, message string")
    claims = log.where(success_claim("message")).selectExpr("commit", "split(message, '\\n')[0] AS message").collect()
    changed = sound.where("NOT (before <=> after)").count()
    return {"since": since or "the start of this branch", "base": base, "files_changed": changed, "commits": len(messages), "facts": facts, "success_claims": [c.asDict() for c in claims], "not_checked": [*NOT_CHECKED, *unread]}


def suppression(action: str, reason: str) -> dict:
    """A decision as SARIF shows it beside a result."""
    return {"kind": "external", "status": "accepted" if action == "ignore" else "underReview", "justification": reason}
