"""Which statistics a table needs, which of its columns stay, and in what order."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .cutoff import clauses

#: Sides of a statistic, what is made when none is named, and the columns that statistics have.
BASE = ("any2any", "spe2any", "any2spe", "spe2spe")
ALL = ("any2any", "any2spe", "any2dif", "dif2any", "dif2spe", "dif2dif", "spe2any", "spe2spe", "spe2dif")
DEFAULT = ("any2any", "any2dif", "any2spe")
PREFIXES = ("OCN", "OCS", "ECN", "ECS", "dNC", "dSC", "omegaC")
#: Preference among statistics for the default cut-off.
PREFERRED = ("any2spe", "any2dif", "any2any", "spe2spe", "spe2any", "spe2dif", "dif2spe", "dif2any", "dif2dif")


def parse(text: str | list[str] | None) -> list[str]:
    """Statistics of a comma-separated list, lower-case, each once; the default ones for None."""
    names = DEFAULT if text is None else text.split(",") if isinstance(text, str) else text
    names = list(dict.fromkeys(n for n in (str(x).strip().lower() for x in names) if n))
    if not names or set(names) - set(ALL):
        raise ValueError(f"unknown or no statistics in {text!r}; there are {', '.join(ALL)}")
    return names


def _parts(stat: str) -> set[str]:
    """Base statistics that a sum or difference of gives ``stat``: a side 'dif' is 'any' less 'spe'."""
    a, d = (("any", "spe") if side == "dif" else (side,) for side in stat.split("2"))
    return {f"{x}2{y}" for x in a for y in d}


def required_base(stats) -> list[str]:
    """Base statistics that must be counted to give ``stats``."""
    needed = set().union(*map(_parts, parse(stats)))
    return [s for s in BASE if s in needed]


def required_differences(stats) -> list[str]:
    """Differences to be formed; dif2dif is one of any2dif and spe2dif."""
    needed = {s for s in parse(stats) if "dif" in s}
    needed |= {"any2dif", "spe2dif"} if "dif2dif" in needed else set()
    return [s for s in ALL if s in needed]


def default_cutoff(stats) -> str:
    names = parse(stats)
    best = next(s for s in PREFERRED if s in names)
    return f"OCN{best},2.0|omegaC{best},5.0"


def check_cutoff(text: str, stats) -> None:
    """Fails where a clause's pattern means a column of a statistic that is not made."""
    names = parse(stats)
    for clause in clauses(text):
        pattern = clause.rpartition(",")[0].strip()
        try:
            meant = {s for s in ALL for p in PREFIXES if pattern and re.fullmatch(pattern, p + s)}
        except re.error:
            continue  # told when the clause itself is parsed
        if meant - set(names):
            raise ValueError(f"cut-off {pattern!r} needs the statistics {', '.join(sorted(meant - set(names)))}")


def requested_columns(columns: list[str], stats) -> list[str]:
    """Columns without those of statistics that were not asked for (nor their *_nocalib)."""
    gone = {p + s + end for s in ALL if s not in parse(stats) for p in PREFIXES for end in ("", "_nocalib")}
    return [c for c in columns if c not in gone]


def requested(df: DataFrame, stats) -> DataFrame:
    return df.select(*[f"`{c}`" for c in requested_columns(df.columns, stats)])


#: Groups of the cb table's columns in their order, each sorted by name within.
_CB_ORDER = (r"dist_.*", r"branch_num_.*", r"is_.*", r"omegaC(?!.*_nocalib$).*", r"d[NS]C(?!.*_nocalib$).*", r"OC[NS]CoD", r"OC[NS]_linreg_residual", r"[NS]_sub_.*", r"OC[NS](any|dif|spe).*", r"EC[NS](any|dif|spe).*", r"omegaC.*_nocalib", r"d[NS]C.*_nocalib")
_SUMMARY_ORDER = ("arity", "elapsed_sec", "cutoff_stat", "fg_enrichment_factor", "mode", "dSC_calibration")


def ordered_columns(columns: list[str]) -> list[str]:
    """Columns of a cb table: ids by number, then the groups above, then the others as they came."""
    members = sorted((c for c in columns if re.fullmatch(r"branch_id_\d+", c)), key=lambda c: int(c.rpartition("_")[2]))
    out = members + [c for pattern in _CB_ORDER for c in sorted(columns) if re.fullmatch(pattern, c)]
    return list(dict.fromkeys(out + columns))


def ordered(cb: DataFrame) -> DataFrame:
    return cb.select(*[f"`{c}`" for c in ordered_columns(cb.columns)])


def summary_columns(columns: list[str]) -> list[str]:
    """Columns of a cb summary: the run's, then num_*, then the others as they came."""
    return list(dict.fromkeys([c for c in _SUMMARY_ORDER if c in columns] + [c for c in columns if c.startswith("num_")] + columns))


def without_placeholders(df: DataFrame, placeholder: str = "PLACEHOLDER") -> DataFrame:
    """Column names without a trailing placeholder."""
    return df.toDF(*[re.sub(rf"_?{re.escape(placeholder)}$", "", c) for c in df.columns])


def single_branch(df: DataFrame) -> DataFrame:
    """For one branch: without the counts that only combinations have."""
    return df.drop(*[f"OC{channel}{s}" for channel in "SN" for s in ALL])
