"""The cut-off language: 'regex,value|regex,value'."""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import at_least


def clauses(text: str) -> list[str]:
    """Clauses without quotes and empty ones; '|' within brackets, braces, parentheses or after a backslash belongs to a pattern."""
    out, open_, escaped, current = [], dict.fromkeys(")]}", 0), False, ""
    for c in text:
        if c == "|" and not any(open_.values()) and not escaped:
            out.append(current)
            current = ""
            continue
        if not escaped and c in "([{":
            open_[")]}"["([{".index(c)]] += 1
        elif not escaped and open_.get(c):
            open_[c] -= 1
        escaped = c == "\\" and not escaped
        current += c
    return [c for c in (x.replace("'", "").replace('"', "").strip() for x in [*out, current]) if c]


def parse(text: str) -> list[tuple[str, float]]:
    """Pattern and least value of each clause; values must be finite."""
    out = []
    for clause in clauses(text):
        pattern, comma, value = (x.strip() for x in clause.rpartition(","))
        if not comma or not pattern or not value:
            raise ValueError(f"cut-off {clause!r} is not 'regex,value'")
        re.compile(pattern)
        if not math.isfinite(least := float(value)):
            raise ValueError(f"cut-off {clause!r} needs a finite value")
        out.append((pattern, least))
    if not out:
        raise ValueError(f"no cut-off in {text!r}")
    return out


def predicate(text: str, columns: list[str]) -> Column:
    """All columns that match a clause's whole pattern reach its value; a pattern must match some column; NaN and null fail."""
    tests = []
    for pattern, value in parse(text):
        names = [c for c in columns if re.fullmatch(pattern, c)]
        if not names:
            raise ValueError(f"no column matches {pattern!r}")
        tests += [at_least(F.col(c), value) for c in names]
    return reduce(lambda a, b: a & b, tests)


def qualified(cb: DataFrame, text: str) -> DataFrame:
    return cb.where(predicate(text, cb.columns))
