"""Packrat parsing of parsing-expression grammars.

A grammar is a table of named rules; an expression is a function ``(run, pos) -> (end, value) | None``.  Rules are
memoised for each position, so a parse takes time linear in the text however the alternatives back up.  Terminals are
regular expressions matched at the position; ``span`` keeps source offsets, ``act`` is a semantic action.
"""

from __future__ import annotations

import re
from collections.abc import Callable

Expr = Callable[["Run", int], "tuple[int, object] | None"]


class Run:
    """One text under one grammar, with its memo table."""

    __slots__ = ("memo", "rules", "text")

    def __init__(self, rules: dict[str, Expr], text: str):
        self.rules, self.text, self.memo = rules, text, {}


def rx(pattern: str) -> Expr:
    match = re.compile(pattern).match

    def parse(run: Run, pos: int):
        m = match(run.text, pos)
        return (m.end(), None) if m else None

    return parse


def ref(name: str) -> Expr:
    def parse(run: Run, pos: int):
        key = (name, pos)
        if key not in run.memo:
            run.memo[key] = None  # left recursion fails
            run.memo[key] = run.rules[name](run, pos)
        return run.memo[key]

    return parse


def seq(*parts: Expr) -> Expr:
    def parse(run: Run, pos: int):
        values = []
        for part in parts:
            got = part(run, pos)
            if got is None:
                return None
            pos, value = got
            if value is not None:
                values.append(value)
        return pos, values

    return parse


def first(*parts: Expr) -> Expr:
    def parse(run: Run, pos: int):
        for part in parts:
            got = part(run, pos)
            if got is not None:
                return got
        return None

    return parse


def many(part: Expr) -> Expr:
    def parse(run: Run, pos: int):
        values = []
        while (got := part(run, pos)) is not None and got[0] > pos:
            pos, value = got
            if value is not None:
                values.append(value)
        return pos, values

    return parse


def maybe(part: Expr) -> Expr:
    def parse(run: Run, pos: int):
        return part(run, pos) or (pos, None)

    return parse


def ahead(part: Expr, wanted: bool = True) -> Expr:
    def parse(run: Run, pos: int):
        return (pos, None) if (part(run, pos) is not None) is wanted else None

    return parse


def span(kind: str, part: Expr) -> Expr:
    def parse(run: Run, pos: int):
        got = part(run, pos)
        return (got[0], (kind, pos, got[0])) if got else None

    return parse


def act(part: Expr, action: Callable[[str, object], object]) -> Expr:
    def parse(run: Run, pos: int):
        got = part(run, pos)
        return (got[0], action(run.text, got[1])) if got else None

    return parse


def parse(rules: dict[str, Expr], start: str, text: str):
    """Value of ``start`` at the beginning of ``text``, or None."""
    got = rules[start](Run(rules, text), 0)
    return got[1] if got else None
