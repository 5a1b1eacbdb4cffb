"""Pseudocounts of observed and expected counts."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import ieee_div
from ..plans.statistics import ALL, parse

MODES, TARGETS = ("none", "symmetric", "empirical"), ("observed", "expected", "both")


@dataclass(frozen=True)
class Pseudocount:
    """alpha of None is to be estimated; mode says how it spreads over statistics, target which counts get it."""

    alpha: float | None = 0.0
    mode: str = "none"
    target: str = "both"

    def __post_init__(self):
        if self.mode not in MODES or self.target not in TARGETS:
            raise ValueError(f"modes are {', '.join(MODES)}, targets {', '.join(TARGETS)}")
        if self.alpha is not None and not (math.isfinite(self.alpha) and self.alpha >= 0):
            raise ValueError("alpha is a finite number from 0 on")

    @classmethod
    def of(cls, alpha: str | float = 0.0, mode: str = "none", target: str = "both") -> Pseudocount:
        """From text as a user writes it; alpha may be 'auto'."""
        text = str(alpha).strip().lower()
        return cls(None if text == "auto" else float(text), mode.strip().lower(), target.strip().lower())

    @property
    def enabled(self) -> bool:
        return self.mode != "none" and (self.alpha is None or self.alpha > 0)


def atomic(stat: str) -> np.ndarray:
    """Which of spe2spe, spe2dif, dif2spe and dif2dif a statistic is the sum of."""
    a, d = stat.split("2")
    return np.array([float(a in ("any", x) and d in ("any", y)) for x in ("spe", "dif") for y in ("spe", "dif")])


def stat_alphas(masses: dict[str, float], stats, alpha: float, mode: str = "empirical") -> dict[str, float]:
    """alpha of each statistic. symmetric: the same for all. empirical: alpha times the share of its atomic classes.

    Those shares are the least-squares solution of the statistics' total masses
    (a row of the cb table's sums, so a small system), negative ones being 0 and
    none quite 0; without any mass all are alike.
    """
    names = parse(stats)
    if mode == "none" or alpha == 0:
        return dict.fromkeys(names, 0.0)
    if mode == "symmetric":
        return dict.fromkeys(names, float(alpha))
    known = {s: max(float(m), 0.0) for s, m in masses.items() if s in ALL and m is not None and math.isfinite(m)}
    share = np.full(4, 0.25)
    if known:
        x = np.clip(np.linalg.lstsq(np.stack([atomic(s) for s in known]), np.array(list(known.values())), rcond=None)[0], 0, None)
        share = x / x.sum() if x.sum() > 0 else share
    share = np.maximum(share, np.finfo(float).tiny)
    share /= share.sum()
    return {s: float(alpha * (atomic(s) @ share)) for s in names}


def total_masses(cb: DataFrame, prefix: str, stats) -> dict[str, float]:
    """Sums of each statistic's finite counts over the table."""
    names = parse(stats)
    v = lambda s: F.when(~F.isnan(f"{prefix}{s}") & (F.abs(f"{prefix}{s}") < F.lit(float("inf"))), F.col(f"{prefix}{s}"))
    return cb.agg(*[F.sum(v(s)).alias(s) for s in names]).first().asDict()


def smoothed_ratio(observed, expected, alpha_observed: float, alpha_expected: float):
    """(observed + alpha) / (expected + alpha) as a Column; 0 / 0 is 0."""
    o, e = observed + alpha_observed, expected + alpha_expected
    return F.when((o == 0) & (e == 0), 0.0).otherwise(ieee_div(o, e))


def add_smoothed_rates(cb: DataFrame, alphas: dict[str, float], target: str = "both") -> DataFrame:
    """dNC, dSC and omegaC of the statistics with their alphas added, as *_smoothed beside the raw columns."""
    for s, alpha in alphas.items():
        on, en = (alpha if target in (t, "both") else 0.0 for t in ("observed", "expected"))
        cb = cb.withColumns({f"d{c}C{s}_smoothed": smoothed_ratio(F.col(f"OC{c}{s}"), F.col(f"EC{c}{s}"), on, en) for c in "NS"})
        n, d = F.col(f"dNC{s}_smoothed"), F.col(f"dSC{s}_smoothed")
        cb = cb.withColumn(f"omegaC{s}_smoothed", F.when((n == 0) & (d == 0), 0.0).otherwise(ieee_div(n, d)))
    return cb
