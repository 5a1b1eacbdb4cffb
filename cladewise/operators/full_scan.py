"""The whole scan for many foregrounds at once, the observed one among them.

A round is a foreground, and one more key: rounds find their own candidates, but
what a candidate weighs on a branch is the same in all of them and is summed
once; a round's units and targets are then joined to it by branch.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.settled import settled
from . import permute, scan
from .scan import KEYS


def least_units(value: str, units: Column) -> Column:
    """scan.support_threshold for a number of units that is a column."""
    scan.support_threshold(value, 1)  # fails on what isn't a threshold
    v = Decimal(str(value))
    if "." in str(value) and v <= 1:
        return F.ceil(F.lit(v) * units).cast("long")
    return F.lit(int(v)).cast("long")


def round_candidates(called: DataFrame, units: DataFrame, classes) -> DataFrame:
    """round, KEYS, from_states, to_states: candidates in the events of each round's units.

    The key of a 'dif' side is the set of its states, as it differs between rounds.
    """
    seen = called.groupBy("branch_id", "site", "a", "d").agg(F.sum("pp").alias("pp")).join(units.select("round", "branch_id").distinct(), "branch_id")
    c = scan.all_candidates(seen, classes, ("round",))
    key = lambda k, states: F.when(F.col(k) == "dif", F.array_join(F.col(states).cast("array<string>"), ",")).otherwise(F.col(k))
    return c.withColumns({"key_a": key("key_a", "from_states"), "key_d": key("key_d", "to_states")}).drop("mass")


def full_scan(called: DataFrame, units: DataFrame, branches: DataFrame, classes=tuple(scan.CLASSES), min_pp: float = 0.5, support: str = "2", rated: DataFrame | None = None, targets: DataFrame | None = None, others: DataFrame | None = None) -> DataFrame:
    """round, KEYS, from_states, to_states, units, xt, xo, lt, lo, lrt of each round's candidates that enough of its units support.

    called: events (branch_id, site, a, d, pp) that make candidates and support;
    rated: those that rates count (the same by default). units: round, unit,
    branch_id; targets: round, branch_id whose rate is tested (by default the
    units' branches); others: round, branch_id they are compared with (by
    default all branches that are no targets). branches: branch_id, exposure.

    A unit supports a candidate if one of its branches has ``min_pp`` of it.
    ``lrt`` is null where targets or others have no exposure.
    """
    c = settled(round_candidates(called, units, classes))
    mass = settled(scan.branch_masses(c, called))
    rate_mass = mass if rated is None else settled(scan.branch_masses(c, rated))
    need = units.groupBy("round").agg(F.count_distinct("unit").alias("_n")).select("round", least_units(support, F.col("_n")).alias("_least"))
    unit = mass.join(units, "branch_id").groupBy("round", *KEYS, "unit").agg(F.max("m").alias("m")).where((F.col("m") > 0) & (F.col("m") >= min_pp))
    held = unit.groupBy("round", *KEYS).agg(F.count(F.lit(1)).alias("units")).join(need, "round").where("units >= _least").drop("_least")
    valid = branches.select("branch_id")
    own = (units if targets is None else targets).select("round", "branch_id").distinct().join(valid, "branch_id", "left_semi")
    per_round = lambda who, name: rate_mass.join(who, "branch_id").groupBy("round", *KEYS).agg(F.sum("m").alias(name))
    out = c.join(held, ["round", *KEYS]).join(per_round(own, "xt"), ["round", *KEYS], "left").fillna(0.0, ["xt"])
    if others is None:
        total = rate_mass.join(valid, "branch_id").groupBy(*KEYS).agg(F.sum("m").alias("_all"))
        out = out.join(total, KEYS, "left").withColumn("xo", F.greatest(F.coalesce("_all", F.lit(0.0)) - F.col("xt"), F.lit(0.0))).drop("_all")
    else:
        others = others.select("round", "branch_id").distinct().join(valid, "branch_id", "left_semi").join(own, ["round", "branch_id"], "left_anti")
        out = out.join(per_round(others, "xo"), ["round", *KEYS], "left").fillna(0.0, ["xo"])
    out = out.join(permute.round_lengths(own, branches, others), "round", "left").fillna(0.0, ["lt", "lo"])
    return out.withColumn("lrt", permute.larger_rate_statistic(*[F.col(x) for x in ("xt", "xo", "lt", "lo")]))


def calibrated_scan(scanned: DataFrame, rounds: int, observed: int = 0) -> DataFrame:
    """The rows of round ``observed`` with empirical and empirical_max p against the ``rounds`` others that could be drawn."""
    scanned = settled(scanned)
    own = scanned.where(F.col("round") == observed).drop("round")
    return permute.calibrated(own, scanned.where(F.col("round") != observed).select("round", *KEYS, "lrt"), rounds, fixed=False)
