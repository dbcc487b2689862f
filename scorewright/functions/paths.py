"""Paths of a submitted workspace: relative, inside the root, and with declared parameters only."""

from __future__ import annotations

import re

#: In the order in which a path is judged: what is wrong, and the pattern of a path that has it.
FAULTS = (
    ("is not relative with forward slashes", r"\A\z|\A/|\\"),
    ("starts with a drive", r"\A[A-Za-z]:"),
    ("has an empty or dotted part", r"(?:\A|/)(?:\.{0,2})(?:/|\z)"),
)
PARAMETER = r"\{([^{}]*)\}"


def placeholders(text: str) -> set[str]:
    return set(re.findall(PARAMETER, text))


def path_problem(path: str, parameters: set[str]) -> str | None:
    for said, pattern in FAULTS:
        if re.search(pattern.replace(r"\z", r"\Z"), path):
            return said
    return "names an undeclared parameter" if placeholders(path) - parameters else None


def path_fault(path: str, parameters: str) -> str:
    """SQL: what is wrong with a path, or null; parameters is an array column."""
    cases = " ".join(f"WHEN {path} rlike r'{p}' THEN '{said}'" for said, p in FAULTS)
    return f"CASE {cases} WHEN size(array_except(regexp_extract_all({path}, r'{PARAMETER}', 1), {parameters})) > 0 THEN 'names an undeclared parameter' END"
