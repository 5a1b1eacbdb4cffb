"""Empirical p- and q-values of omegaC: rates of both channels under permuted substitutions.

In a round every branch draws anew, for each feature (group and states) of each
statistic, the sites of its own number of substitutions. Overlaps of the
members of a combination are its permuted counts, and from them its rates and
omegaC come as from the observed ones, calibration included. The round is one
more key of all of it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite, rate
from ..plans.settled import settled
from ..plans.statistics import required_base, required_differences
from .combine import add_some_differences, ids
from .events import FEATURES, projections
from .ranking import bh_qvalues, quantile_map

FEATURE = ["stat", "grp", "a", "d"]


def feature_draws(events: DataFrame, stats) -> DataFrame:
    """branch_id, stat, grp, a, d, n: each branch's number of substitutions of each feature of the base statistics."""
    return projections(events, required_base(list(stats))).groupBy("branch_id", *FEATURE).agg(F.round(F.sum("v"), 9).alias("n")).where("n > 0")


def drawn_sites(weights: DataFrame, draws: DataFrame, first: int, last: int, seed: int = 1) -> DataFrame:
    """branch_id, stat, grp, a, d, round, site: the sites that each branch draws for each feature, without replacement, in rounds ``first`` to ``last``.

    weights: branch_id, site, weight, for all features alike or, with the
    columns of a feature, for each. The n smallest of -ln(u) / weight are drawn;
    u is a hash of the seed and all keys, so the result depends on nothing else.
    A fractional n is rounded anew each time, up as often as its fraction says.
    """
    keys = ["branch_id", *FEATURE]
    uniform = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(2**40)) + 0.5) / float(2**40)
    on = [c for c in keys if c in weights.columns]
    rounds = draws.withColumn("round", F.explode(F.sequence(F.lit(first), F.lit(last))))
    up = uniform(*keys, "round", F.lit("size")) < F.col("n") - F.floor("n")
    rounds = rounds.withColumn("_size", F.floor("n") + up.cast("long")).where("_size > 0")
    rows = rounds.join(weights.where("weight > 0"), on).withColumn("_key", -F.ln(uniform(*keys, "round", "site")) / F.col("weight"))
    order = Window.partitionBy(*keys, "round").orderBy("_key", "site")
    return rows.withColumn("_r", F.row_number().over(order)).where("_r <= _size").select(*keys, "round", "site")


def permuted_counts(drawn: DataFrame, combinations: DataFrame, k: int, prefix: str, stats) -> DataFrame:
    """ids, round and one column for each base statistic: sites and features that all members of a combination drew; only where there are any."""
    side = lambda i: drawn.withColumnRenamed("branch_id", f"branch_id_{i}")
    on = ["round", "site", *FEATURE]
    met = side(1).join(side(2), on).where("branch_id_1 < branch_id_2") if k >= 2 else side(1)
    if k == 2:
        met = met.join(combinations.select(*ids(2)), ids(2))
    elif k > 2:  # from pairs on, one more member of a wanted combination at a time
        for i in range(2, k + 1):
            wanted = combinations.select(*ids(i)).distinct()
            met = met.join(wanted, ids(i)) if i == 2 else met.join(side(i), on).join(wanted, ids(i))
    count = lambda s: F.count_if(F.col("stat") == s).cast("double").alias(f"{prefix}{s}")
    return met.groupBy(*ids(k), "round").agg(*[count(s) for s in stats])


def null_omegas(cb: DataFrame, counts: DataFrame, k: int, stats, first: int, last: int, calibrated: bool = False) -> DataFrame:
    """ids, round, omegaC of each statistic: from permuted counts (OCN and OCS of the base statistics) and the expected ones of ``cb``.

    A combination without a row in ``counts`` has counted nothing. ``calibrated``: dSC is mapped on dNC within each round.
    """
    base = required_base(list(stats))
    grid = cb.select(*ids(k), *[f"EC{c}{s}" for c in "NS" for s in stats]).withColumn("round", F.explode(F.sequence(F.lit(first), F.lit(last))))
    out = grid.join(counts, [*ids(k), "round"], "left").fillna(0.0, [f"OC{c}{s}" for c in "NS" for s in base])
    for c in "NS":
        out = add_some_differences(out, f"OC{c}", required_differences(list(stats)))
    for s in stats:
        out = out.withColumns({f"dNC{s}": rate(F.col(f"OCN{s}"), F.col(f"ECN{s}")), f"dSC{s}": rate(F.col(f"OCS{s}"), F.col(f"ECS{s}"))})
        if calibrated:
            out = quantile_map(out, f"dNC{s}", f"dSC{s}", "_mapped", ["round"]).withColumn(f"dSC{s}", F.col("_mapped")).drop("_mapped")
        out = out.withColumn(f"omegaC{s}", rate(F.col(f"dNC{s}"), F.col(f"dSC{s}")))
    return out.select(*ids(k), "round", *[f"omegaC{s}" for s in stats])


def _counted(rows: DataFrame, null: DataFrame, k: int, stats) -> DataFrame:
    """Adds to ge and n of each statistic what a stage's null omegas show; those that are NaN don't count."""
    met = rows.join(null.withColumnsRenamed({f"omegaC{s}": f"_{s}" for s in stats}), ids(k), "left")
    known = lambda s: F.col(f"_{s}").isNotNull() & ~F.isnan(f"_{s}")
    sums = reduce(lambda a, s: a + [F.count_if(known(s) & (F.col(f"_{s}") >= F.col(f"omegaC{s}"))).alias(f"_ge{s}"), F.count_if(known(s)).alias(f"_n{s}")], stats, [])
    met = met.groupBy(*rows.columns).agg(*sums)
    return met.withColumns({f"{x}{s}": F.col(f"{x}{s}") + F.col(f"_{x}{s}") for s in stats for x in ("ge", "n")}).select(*rows.columns)


def omega_pvalues(cb: DataFrame, weights: dict[str, DataFrame], draws: dict[str, DataFrame], k: int, stats, schedule: tuple[int, ...] = (100, 1000), edge: int = 5, calibrated: bool = False, seed: int = 1) -> DataFrame:
    """Adds pomegaC and qomegaC of each statistic, the share of rounds whose omegaC is as large and its Benjamini-Hochberg value.

    cb: ids, ECN, ECS and omegaC of each statistic; weights and draws by channel
    (N, S) as for drawn_sites. ``schedule``: rounds in all after each stage.
    Only combinations with at most ``edge`` rounds as large in one of the
    statistics, or none that counts, go on to the next stage; with
    ``calibrated`` all do, as each round ranks all of them. p = (ge + 1) /
    (n + 1); NaN where omegaC is NaN, the expected S count isn't finite or no
    round counts.
    """
    if not schedule or list(schedule) != sorted(set(schedule)) or schedule[0] < 1:
        raise ValueError("the schedule must rise")
    base = required_base(list(stats))
    zero = F.lit(0).cast("long")
    counters = {f"{x}{s}": zero for s in stats for x in ("ge", "n")}
    active = settled(cb.select(*ids(k), *[f"{x}{s}" for s in stats for x in ("ECN", "ECS", "omegaC")]).withColumns(counters))
    done, before = None, 0
    for total in schedule:
        counts = None
        for i, c in enumerate("NS"):
            drawn = settled(drawn_sites(weights[c], draws[c], before + 1, total, 2 * seed + i))
            own = permuted_counts(drawn, active, k, f"OC{c}", base)
            counts = own if counts is None else counts.join(own, [*ids(k), "round"], "full")
        rows = settled(_counted(active, null_omegas(active, counts, k, stats, before + 1, total, calibrated), k, stats))
        if total == schedule[-1] or calibrated:
            finished, active = rows, rows
        else:
            coarse = reduce(lambda a, s: a | (_has_p(s) & ((F.col(f"ge{s}") <= edge) | (F.col(f"n{s}") == 0))), stats, F.lit(False))
            finished, active = rows.where(~coarse), rows.where(coarse)
        done = finished if done is None or calibrated else done.unionByName(finished)
        before = total
    for s in stats:
        p = F.when(_has_p(s) & (F.col(f"n{s}") > 0), (F.col(f"ge{s}") + 1) / (F.col(f"n{s}") + 1)).otherwise(float("nan"))
        done = bh_qvalues(settled(done.withColumn(f"pomegaC{s}", p)), f"pomegaC{s}", out=f"qomegaC{s}").fillna(float("nan"), [f"qomegaC{s}"])
    return cb.join(done.select(*ids(k), *[f"{x}omegaC{s}" for s in stats for x in "pq"]), ids(k))


def _has_p(s: str):
    return F.col(f"omegaC{s}").isNotNull() & ~F.isnan(f"omegaC{s}") & finite(F.col(f"ECS{s}"))
