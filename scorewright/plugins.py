"""Extensions that other packages advertise under entry points: operators, relations, commands and three reserved groups.

Discovery never fails: what cannot be used is left out with a warning. This package's own entries come first, then others
by the name of their package; the first owner of a name keeps it.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from importlib.metadata import EntryPoint, entry_points

#: Changes only when an extension written for it would break.
API = 1
OWN = "scorewright"
GROUPS = tuple(f"{OWN}.{x}" for x in ("mutators", "relations", "commands", "adapters", "probes", "renderers"))
OPERATORS, RELATIONS, COMMANDS = GROUPS[:3]


class Operator:
    """A table function over tasks: the submissions that it makes of one task. ids are its name and the shapes it runs on, all if none."""

    id = ""
    shapes: tuple[str, ...] = ()

    def apply(self, task: dict) -> Iterator[dict]:
        """task: task_id, shape, prompt, reference. Yields text or files, commands, parameters, with ground and detail."""
        raise NotImplementedError


class Relation:
    """A rewriting of an answer that is certified not to change what it says; None where it does not apply."""

    id = ""

    def render(self, answer: str) -> str | None:
        raise NotImplementedError


def owner(e: EntryPoint) -> str:
    return e.dist.name if e.dist is not None else ""


def load(group: str, found: Iterable[EntryPoint] | None = None, base: type = object) -> dict[str, type]:
    """The usable classes of a group by name."""
    if group not in GROUPS:
        raise ValueError(f"{group} is no group of extensions")
    usable: dict[str, type] = {}
    entries = entry_points(group=group) if found is None else found
    for e in sorted(entries, key=lambda e: (owner(e) != OWN, owner(e), e.name)):
        try:
            wrong = f"{e.name} is taken" if e.name in usable else None
            thing = None if wrong else e.load()
        except Exception as x:  # noqa: BLE001  an extension must not stop the others
            wrong = f"cannot be loaded: {x}"
        if wrong is None and not isinstance(thing, type):
            wrong = "is no class"
        if wrong is None and getattr(thing, "plugin_api", API) != API:
            wrong = f"is written for version {thing.plugin_api}, not {API}"
        if wrong is None and not issubclass(thing, base):
            wrong = f"is no {base.__name__}"
        if wrong:
            warnings.warn(f"extension {e.name} of {owner(e) or 'a package'} in {group}: {wrong}", stacklevel=2)
        else:
            usable[e.name] = thing
    return usable


@dataclass(frozen=True)
class Proposed:
    text: str | None
    files: dict | None
    commands: tuple[str, ...]
    parameters: tuple[str, ...]
    operator: str
    detail: str
    ground: str | None


def extended(operators: dict[str, type]) -> Callable[[str, str], Iterator[Proposed]]:
    """What loaded operators propose for (reference, shape), in the order of their names; an operator that fails proposes nothing more."""

    def run(reference: str, shape: str) -> Iterator[Proposed]:
        for name in sorted(operators):
            op = operators[name]()
            if op.shapes and shape not in op.shapes:
                continue
            try:
                for c in op.apply({"shape": shape, "reference": reference}):
                    yield Proposed(c.get("text"), c.get("files"), tuple(c.get("commands", ())), tuple(c.get("parameters", ())), op.id or name, c.get("detail", ""), c.get("ground"))
            except Exception as x:  # noqa: BLE001
                warnings.warn(f"operator {name} failed: {x}", stacklevel=2)

    return run
