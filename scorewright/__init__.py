"""Spark-first analytics for checkers: statistics, scorecards, change facts and evidence records.

The names below are the stable seam: extensions and callers may rely on them while plugins.API stays the same. They are loaded
when first used.
"""

from __future__ import annotations

from importlib import import_module

__version__ = "0.2.0"

_WHERE = {
    "scorewright.operators.power": "task_scores model_scores comparisons duplicate_samples missing_tasks score_flags report_counts findings clusters",
    "scorewright.operators.error_rates": "precision recall maturity with_decisions LEVELS OUTCOMES",
    "scorewright.operators.scoring": "coverage coverage_pairs acceptance acceptance_pairs accepted_baselines exclusions scorecard weaknesses_run verification_gap gap_sides unknown_tasks CATEGORIES WEIGHTS",
    "scorewright.operators.evidence": "conformance_outcomes conformance_rates judge apply_reproductions attribute active_decisions notice_problems flakes detection_power disruptions answers_in_prompts evidence_faults check_scores",
    "scorewright.operators.change_facts": "change_facts file_features test_matches not_checked to_sarif RULES",
    "scorewright.operators.battery": "battery battery_counts proposals positive_controls equivalence submission_json",
    "scorewright.functions.ids": "is_id digest fingerprint finding_id finding_id_of normalise_finding_id refusal success_claim canonical_json",
    "scorewright.functions.intervals": "wilson normal detectable",
    "scorewright.functions.paths": "path_problem path_fault",
    "scorewright.functions.programs": "collision same_program same_tree same_but_local_names",
    "scorewright.sources.strict": "read_lines read_sound numbered_lines RESULTS PLANTED",
    "scorewright.sources.records": "registry_records read_reproduction script_metadata script_problems documents",
    "scorewright.sources.dimensions": "weaknesses crosswalks probes fixtures weakness_markdown weakness_list",
    "scorewright.sources.documents": "decisions format_decisions conformance_results",
    "scorewright.sources.git": "GitChange default_base resolve messages",
    "scorewright.plans.reports": "power_report power_text error_rate_text scorecard_text conformance_text verify_text sarif suppression",
    "scorewright.plugins": "Operator Relation load extended API GROUPS",
}
_HOME = {name: module for module, names in _WHERE.items() for name in names.split()}
__all__ = sorted(_HOME)


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"module {__name__} has no {name}")
    return getattr(import_module(_HOME[name]), name)
