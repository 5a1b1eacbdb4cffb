"""Set expressions over branches, such as '(1|5)-A', compiled to Columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r"\s*(\d+|[Aa|&^()-])")


@dataclass(frozen=True)
class Value:
    """Whether a site is in the set, and with what probability; outside it that is 0."""

    member: Column
    probability: Column

    def __post_init__(self):
        inside = F.coalesce(self.member, F.lit(False))
        object.__setattr__(self, "probability", F.when(inside & ~F.isnan(self.probability), self.probability).otherwise(0.0))
        object.__setattr__(self, "member", inside)


def tokens(text: str) -> list[str]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise ValueError(f"unexpected {text[at:]!r}")
        out.append(m[1].upper())
        at = m.end()
    if not out:
        raise ValueError("empty set expression")
    return out


def branches(text: str) -> list[int]:
    return sorted({int(t) for t in tokens(text) if t.isdigit()})


def compile_expression(text: str, branch: dict[int, Value], others: Value) -> Value:
    """Evaluates the operators at one level from left to right; '-' and '^' next to another operator need parentheses.

    ``others`` is what 'A' stands for: all branches that the expression doesn't name.
    """
    rest = tokens(text)

    def atom() -> Value:
        if not rest:
            raise ValueError("the expression ends early")
        t = rest.pop(0)
        if t == "(":
            v = level()
            if not rest or rest.pop(0) != ")":
                raise ValueError("a parenthesis stays open")
            return v
        if t == "A":
            return others
        if not t.isdigit():
            raise ValueError(f"unexpected {t!r}")
        return branch[int(t)]

    def level() -> Value:
        v, seen = atom(), []
        while rest and rest[0] != ")":
            op = rest.pop(0)
            if op not in "|&^-":
                raise ValueError(f"unexpected {op!r}")
            seen.append(op)
            if len(seen) > 1 and ({"-", "^"} & set(seen)):
                raise ValueError("operators beside '-' or '^' need parentheses")
            v = combine(op, v, atom())
        return v

    out = level()
    if rest:
        raise ValueError(f"unexpected {rest[0]!r}")
    return out


def combine(op: str, x: Value, y: Value) -> Value:
    if op == "|":
        return Value(x.member | y.member, F.greatest(x.probability, y.probability))
    if op == "&":
        return Value(x.member & y.member, F.least(x.probability, y.probability))
    if op == "-":
        return Value(x.member & ~y.member, x.probability)
    return Value(x.member != y.member, F.greatest(x.probability, y.probability))
