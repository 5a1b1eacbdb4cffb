"""Scan for substitutions that recur in foreground units.

A candidate is a site with a class of change. A class names how the ancestral
and the derived side are grouped: 'spe' is one state, 'any' all of them, 'dif'
two or more different ones. Units are independent foreground lineages.
"""

from __future__ import annotations

import math
from decimal import ROUND_CEILING, Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import chi2_sf, ieee_div

KEYS = ["site", "match", "key_a", "key_d"]
CLASSES = [f"{a}2{d}" for a in ("any", "spe", "dif") for d in ("any", "spe", "dif")]


def support_threshold(value: str, units: int) -> int:
    """A whole number of units, or for a fraction up to 1 that share of them, rounded up without binary error."""
    v = Decimal(str(value))
    if v <= 0:
        raise ValueError("support must be positive")
    if "." in str(value) and v <= 1:
        return int((v * units).to_integral_value(ROUND_CEILING))
    if v != int(v):
        raise ValueError("support above 1 must be whole")
    return int(v)


def candidates(events: DataFrame, match: str, by: tuple[str, ...] = ()) -> DataFrame:
    """site, key_a, key_d, from_states, to_states, mass of one class over the given (foreground) events.

    'spe' sides are keys of the grouping; 'any' and 'dif' sides collect the
    states seen, of which 'dif' needs two. With ``by``, such as a round of
    foregrounds, each of its values has candidates of its own.
    """
    a, d = match.split("2")
    keys = [*by, "site"] + [c for c, side in (("a", a), ("d", d)) if side == "spe"]
    g = events.groupBy(*keys).agg(F.array_sort(F.collect_set("a")).alias("from_states"), F.array_sort(F.collect_set("d")).alias("to_states"), F.sum("pp").alias("mass"))
    for side, c in ((a, "from_states"), (d, "to_states")):
        if side == "dif":
            g = g.where(F.size(c) >= 2)
    key = lambda c, side: (F.col(c) if side == "spe" else F.lit(side)).cast("string")
    return g.select(*by, "site", F.lit(match).alias("match"), key("a", a).alias("key_a"), key("d", d).alias("key_d"), "from_states", "to_states", "mass")


def all_candidates(events: DataFrame, classes=tuple(CLASSES), by: tuple[str, ...] = ()) -> DataFrame:
    out = candidates(events, classes[0], by)
    for c in classes[1:]:
        out = out.unionByName(candidates(events, c, by))
    return out


def branch_masses(c: DataFrame, events: DataFrame) -> DataFrame:
    """KEYS, branch_id, m: each branch's mass over the events that a candidate counts.

    An 'any' side allows all states, the others only those of the candidate
    (from_states, to_states): one for 'spe', all that were seen for 'dif'.
    Candidates are split by which of their sides are 'any'; for each of the four
    kinds events are summed to what it tells apart and joined on just that, so
    no event is carried that is thrown away.
    """
    closed = [F.when(F.col(k) != "any", F.col(s)).alias(s) for k, s in (("key_a", "from_states"), ("key_d", "to_states"))]
    keys = c.select(*KEYS, *closed).distinct()
    out = None
    for a_any in (True, False):
        for d_any in (True, False):
            sides = [s for s, any_ in (("a", a_any), ("d", d_any)) if not any_]
            own = keys.where(((F.col("key_a") == "any") == F.lit(a_any)) & ((F.col("key_d") == "any") == F.lit(d_any)))
            for s in sides:
                own = own.withColumn(s, F.explode("from_states" if s == "a" else "to_states"))
            mass = events.groupBy("branch_id", "site", *sides).agg(F.sum("pp").alias("m"))
            part = own.join(mass, ["site", *sides]).select(*KEYS, "branch_id", "m")
            out = part if out is None else out.unionByName(part)
    return out.groupBy(*KEYS, "branch_id").agg(F.sum("m").alias("m"))


def support(c: DataFrame, events: DataFrame, units: DataFrame, min_pp: float, least: int) -> DataFrame:
    """Candidates that reach ``min_pp`` on some branch of ``least`` units: their number, ids and mean of the units' largest mass.

    units: unit, branch_id (few). A branch's mass is summed over the states the candidate allows.
    """
    unit = branch_masses(c, events).join(F.broadcast(units), "branch_id").groupBy(*KEYS, "unit").agg(F.max("m").alias("m")).where(F.col("m") >= min_pp)
    return unit.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("units"), F.array_sort(F.collect_list("unit")).alias("unit_ids"), F.avg("m").alias("mean_mass")).where(F.col("units") >= least)


def enrichment(c: DataFrame, events: DataFrame, branches: DataFrame) -> DataFrame:
    """Events and exposure of target and other branches, rates, their ratio and the likelihood-ratio statistic.

    branches: branch_id, target (boolean), exposure. The statistic is 0 unless
    the target's rate is the larger; ``p`` is half the chi-squared tail.
    """
    total = branches.agg(F.sum(F.when(F.col("target"), F.col("exposure")).otherwise(0.0)).alias("lt"), F.sum(F.when(~F.col("target"), F.col("exposure")).otherwise(0.0)).alias("lo"))
    e = branch_masses(c, events).join(F.broadcast(branches), "branch_id").groupBy(*KEYS)
    e = e.agg(F.sum(F.when(F.col("target"), F.col("m")).otherwise(0.0)).alias("xt"), F.sum(F.when(~F.col("target"), F.col("m")).otherwise(0.0)).alias("xo")).join(F.broadcast(total))
    pooled = (F.col("xt") + F.col("xo")) / (F.col("lt") + F.col("lo"))
    term = lambda x, n: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / (F.col(n) * pooled))).otherwise(0.0)
    e = e.withColumns({"rate_t": ieee_div(F.col("xt"), F.col("lt")), "rate_o": ieee_div(F.col("xo"), F.col("lo"))})
    e = e.withColumn("ratio", ieee_div(F.col("rate_t"), F.col("rate_o")))
    return e.withColumn("lrt", F.when(F.col("rate_t") > F.col("rate_o"), F.greatest(F.lit(0.0), 2 * (term("xt", "lt") + term("xo", "lo")))).otherwise(0.0))


def with_p(e: DataFrame) -> DataFrame:
    """Adds the one-sided p of a likelihood-ratio statistic ``lrt``: 1 where it is 0."""
    return e.withColumn("p", F.when(F.col("lrt") > 0, 0.5 * chi2_sf(F.col("lrt"))).otherwise(1.0))


def opportunity(parents: DataFrame, rates: DataFrame, from_states: list, to_states: list, rescaled: bool) -> DataFrame:
    """node, site, opportunity: a parent's states (node, site, state, p) weighted by the rates (a, d, rate; a <> d) of the changes that a candidate allows.

    A state's weight is the sum of its positive, finite rates to the allowed
    states; ``rescaled``: as a share of all its rates. Rates are few and broadcast.
    """
    good = rates.where((F.col("a") != F.col("d")) & (F.col("rate") > 0) & (F.col("rate") < F.lit(float("inf"))))
    w = good.where(F.col("a").isin(from_states)).groupBy("a").agg(F.sum(F.when(F.col("d").isin(to_states), F.col("rate")).otherwise(0.0)).alias("k"), F.sum("rate").alias("all"))
    w = w.select(F.col("a").alias("state"), (F.col("k") / F.col("all") if rescaled else F.col("k")).alias("w"))
    return parents.join(F.broadcast(w), "state").groupBy("node", "site").agg(F.sum(F.col("p") * F.col("w")).alias("opportunity"))


def result_order(scan: DataFrame) -> DataFrame:
    """Scan rows by trait, match, p and quantile; what isn't known comes last."""
    known = lambda c: F.when(~F.isnan(c), F.col(c)).asc_nulls_last()
    return scan.orderBy("trait", "match", known("p"), known("quantile"), "site", "key_a", "key_d")


def significant_rows(scan: DataFrame, alpha: float) -> DataFrame:
    """Rows whose p is known and at most ``alpha``."""
    return scan.where(F.col("p").isNotNull() & ~F.isnan("p") & (F.col("p") <= alpha))


def conservation(states: DataFrame, n_states: int, tol: float = 1e-9) -> DataFrame:
    """site, major, share, entropy, mass and valid_tips, from states (site, tip, state, p).

    Entropy is over the log of the number of states there are, two at least,
    whether seen or not. Tips with more than ``tol`` mass at a site are valid;
    sites of no more than that have '' and NaN.
    """
    tips = states.groupBy("site", "tip").agg(F.sum("p").alias("p")).groupBy("site").agg(F.count_if(F.col("p") > tol).alias("valid_tips"))
    s = states.groupBy("site", "state").agg(F.sum("p").alias("m")).where("m > 0")
    t = s.groupBy("site").agg(F.sum("m").alias("mass")).where(F.col("mass") > tol)
    j = s.join(t, "site").withColumn("q", F.col("m") / F.col("mass"))
    g = j.groupBy("site").agg(F.min_by("state", F.struct(-F.col("q"), "state")).alias("major"), F.max("q").alias("share"), (-F.sum(F.col("q") * F.ln("q")) / math.log(max(n_states, 2))).alias("entropy"), F.first("mass").alias("mass"))
    return tips.join(g, "site", "left").fillna({"major": "", "share": float("nan"), "entropy": float("nan"), "mass": 0.0})
