"""Names, numbers and labels in text columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def species_label(name: Column, pattern: str, groups: int) -> Column:
    """The first group of a pattern's match that isn't blank, else the whole match; null without one."""
    found = [F.nullif(F.trim(F.regexp_extract(name, pattern, i)), F.lit("")) for i in [*range(1, groups + 1), 0]]
    return F.coalesce(*found)


def residue_number(value: Column) -> Column:
    """A positive whole number of a structure's residue field ('12', '+12', '12.0'); null for anything else."""
    t = F.trim(value.cast("string"))
    n = F.when(t.rlike(r"\A[+-]?[0-9]+(\.0+)?\z"), F.regexp_extract(t, r"^([+-]?[0-9]+)", 1).cast("long"))
    return F.when(n > 0, n)


def accession(name: Column) -> Column:
    """The database accession within a sequence name: of a predicted structure's file, or in one of the two UniProt forms; null without one."""
    #: The accession forms, and what may stand around them.
    forms = [(r"(?i)AF-([A-Z0-9]+)-F[0-9]+", 1), (r"(?i)(^|[^A-Z0-9])([OPQ][0-9][A-Z0-9]{3}[0-9])([^A-Z0-9]|$)", 2), (r"(?i)(^|[^A-Z0-9])([A-NR-Z][0-9](?:[A-Z][A-Z0-9]{2}[0-9]){1,2})([^A-Z0-9]|$)", 2)]
    return F.coalesce(*[F.nullif(F.upper(F.regexp_extract(name, p, i)), F.lit("")) for p, i in forms])


def window_at(sequence: Column, position: Column, most: int) -> Column:
    """A struct of text (at most ``most`` letters around a 1-based position, shifted to stay inside), at (the position in it, from 0) and start; null outside."""
    n, s = F.length(sequence), F.upper(F.trim(sequence))
    start = F.when(n <= most, F.lit(0)).otherwise(F.greatest(F.least(position - 1 - most // 2, n - most), F.lit(0)))
    inside = (position >= 1) & (position <= n)
    return F.when(inside, F.struct(F.substring(s, start + 1, F.lit(most)).alias("text"), (position - 1 - start).alias("at"), start.alias("start")))


def state_label(states: Column, number: Column | int) -> Column:
    """'any' for all states, the state for one, '' for none, else 'dif'."""
    n = F.size(states)
    return F.when(n == 0, "").when(n == number, "any").when(n == 1, F.get(states, F.lit(0)).cast("string")).otherwise("dif")


def with_gaps(aligned: Column, plain: Column) -> Column:
    """Puts the gaps of an aligned text into a plain one of the same ungapped length; null where the lengths differ."""
    letters = F.filter(F.split(aligned, ""), lambda c: c != "")
    seen = F.transform(F.sequence(F.lit(1), F.greatest(F.size(letters), F.lit(1))), lambda i: F.length(F.regexp_replace(F.substring(aligned, F.lit(1), i), "-", "")))
    filled = F.transform(letters, lambda c, i: F.when(c == "-", c).otherwise(F.substring(plain, F.get(seen, i), F.lit(1))))
    same = F.length(F.regexp_replace(aligned, "-", "")) == F.length(plain)
    return F.when(same, F.array_join(filled, ""))


def combinations_count(n: int, r: int) -> int:
    """n over r; 0 where r is larger or either is negative."""
    return math.comb(n, r) if 0 <= r <= n else 0
