"""Shapes of JSON and TOML values, as data: exact types, no unknown keys, and null never stands for a key left out."""

from __future__ import annotations

import json
import math
import re
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field
from typing import Any


class Malformed(ValueError):
    """Where a value departs from its shape, and how."""


@dataclass(frozen=True)
class Text:
    pattern: str | None = None
    among: tuple[str, ...] = ()
    #: What a text may lack: nothing, characters, or characters that are not white space.
    least: str = "any"
    longest: int | None = None

    def check(self, v: Any, at: str) -> None:
        if not isinstance(v, str):
            raise Malformed(f"{at}: not text")
        if (self.least == "some" and not v) or (self.least == "words" and not v.strip()):
            raise Malformed(f"{at}: says nothing")
        if self.among and v not in self.among:
            raise Malformed(f"{at}: none of {', '.join(self.among)}")
        if self.pattern is not None and not re.fullmatch(self.pattern, v):
            raise Malformed(f"{at}: malformed")
        if self.longest is not None and len(v) > self.longest:
            raise Malformed(f"{at}: longer than {self.longest} characters")


@dataclass(frozen=True)
class Flag:
    def check(self, v: Any, at: str) -> None:
        if not isinstance(v, bool):
            raise Malformed(f"{at}: neither true nor false")


@dataclass(frozen=True)
class Number:
    whole: bool = False
    least: float | None = None

    def check(self, v: Any, at: str) -> None:
        if isinstance(v, bool) or not isinstance(v, int if self.whole else (int, float)):
            raise Malformed(f"{at}: not a{' whole' if self.whole else ''} number")
        try:
            sound = math.isfinite(float(v))
        except OverflowError:
            sound = False
        if not sound:
            raise Malformed(f"{at}: not finite")
        if self.least is not None and v < self.least:
            raise Malformed(f"{at}: below {self.least:g}")


@dataclass(frozen=True)
class Items:
    of: Any
    least: int = 0
    once: bool = False

    def check(self, v: Any, at: str) -> None:
        if not isinstance(v, list):
            raise Malformed(f"{at}: not a list")
        if len(v) < self.least:
            raise Malformed(f"{at}: fewer than {self.least}")
        for k, x in enumerate(v):
            self.of.check(x, f"{at}[{k}]")
        if self.once and len({x if isinstance(x, Hashable) else json.dumps(x, sort_keys=True) for x in v}) < len(v):
            raise Malformed(f"{at}: something twice")


@dataclass(frozen=True)
class Table:
    """A table of any keys."""

    key: Any
    of: Any
    nullable: bool = False
    least: int = 0

    def check(self, v: Any, at: str) -> None:
        if not isinstance(v, dict) or len(v) < self.least:
            raise Malformed(f"{at}: not a table of {self.least} or more")
        for k, x in v.items():
            self.key.check(k, at)
            if not (self.nullable and x is None):
                self.of.check(x, f"{at}.{k}")


@dataclass(frozen=True)
class Either:
    shapes: tuple[Any, ...]

    def check(self, v: Any, at: str) -> None:
        for s in self.shapes:
            try:
                return s.check(v, at)
            except Malformed:
                continue
        raise Malformed(f"{at}: of no known form")


@dataclass(frozen=True)
class Record:
    """needs: keys that must be there; may: keys that may. rules say what a sound record must be, and what to say if it is not."""

    needs: dict[str, Any]
    may: dict[str, Any] = field(default_factory=dict)
    rules: tuple[tuple[Callable[[dict], bool], str], ...] = ()
    open: bool = False

    def check(self, v: Any, at: str) -> None:
        if not isinstance(v, dict):
            raise Malformed(f"{at}: not an object")
        known = self.needs | self.may
        for k in sorted(set(v) - set(known)) if not self.open else ():
            raise Malformed(f"{at}: unknown key {k}")
        for k in sorted(set(self.needs) - set(v)):
            raise Malformed(f"{at}: {k} is missing")
        for k in known:
            if k in v:
                known[k].check(v[k], f"{at}.{k}" if at else k)
        for sound, otherwise in self.rules:
            if not sound(v):
                raise Malformed(f"{at}: {otherwise}" if at else otherwise)


def parse(text: str) -> Any:
    """The JSON value of a text. Names that JSON does not have, and nesting beyond the parser's depth, are refused."""

    def refuse(name: str) -> None:
        raise Malformed(f"{name} is not JSON")

    try:
        return json.loads(text, parse_constant=refuse)
    except RecursionError as x:
        raise Malformed("nested too deep") from x
    except json.JSONDecodeError as x:
        raise Malformed("not JSON") from x


def problem(shape: Any, v: Any, at: str = "") -> str | None:
    try:
        shape.check(v, at)
    except Malformed as x:
        return str(x)
    return None
