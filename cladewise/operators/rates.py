"""Rates of observed over expected counts, their calibration, and related columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import chi2_sf, finite, ieee_div, rate
from ..plans.settled import settled
from .combine import counts_of, nan_below_root
from .events import projections
from .expected import closed_form_projections
from .gamma import gamma_map
from .ranking import quantile_map


def add_rates(cb: DataFrame, stats: list[str], alpha: float = 0.0) -> DataFrame:
    """dNC, dSC and omegaC of each statistic; with ``alpha`` counts are smoothed by adding it on both sides."""
    for s in stats:
        o = {c: F.col(f"OC{c}{s}") + alpha for c in "NS"}
        e = {c: F.col(f"EC{c}{s}") + alpha for c in "NS"}
        cb = cb.withColumns({f"dNC{s}": rate(o["N"], e["N"]), f"dSC{s}": rate(o["S"], e["S"])})
        cb = cb.withColumn(f"omegaC{s}", rate(F.col(f"dNC{s}"), F.col(f"dSC{s}")))
    return cb


def observed_and_expected(observed: dict[str, DataFrame], vectors: dict[str, tuple[DataFrame, DataFrame]], combinations: DataFrame, k: int, stats, below_root: DataFrame | None = None, urns: dict[str, DataFrame] | None = None) -> DataFrame:
    """The cb table from events and state vectors of the channels: OCN, OCS, ECN and ECS of each statistic.

    observed: events by channel; vectors: (parent, expected child) by channel,
    as for expected.closed_form_projections, so no table of all pairs of states
    is made unless spe2spe is asked for. Site categories are groups of the
    vectors and are summed over. Expected counts of combinations with a branch
    right below the root (``below_root``) are NaN. With ``urns``, projections by
    channel as of expected.urn_projections, these give the expected counts in
    place of the vectors, of which there may be none. All channels meet in one
    join, told apart by the statistic's name.
    """
    parts = {f"OC{channel}": projections(events, stats) for channel, events in observed.items()}
    parts |= {f"EC{channel}": closed_form_projections(parent, child, stats) for channel, (parent, child) in vectors.items()} if urns is None else {f"EC{channel}": p.where(F.col("stat").isin(list(stats))) for channel, p in urns.items()}
    every = None
    for prefix, p in parts.items():
        p = p.withColumns({"stat": F.concat(F.lit(prefix), "stat"), "grp": F.col("grp").cast("int")})
        every = p if every is None else every.unionByName(p)
    cb = counts_of(settled(every), combinations, k, "", [f"{prefix}{s}" for prefix in parts for s in stats])
    return cb if below_root is None else nan_below_root(cb, below_root, k)


def add_convergence_divergence(cb: DataFrame, prefix: str = "OCN") -> DataFrame:
    """Convergent over divergent counts: any2spe / any2dif."""
    return cb.withColumn(f"{prefix}CoD", ieee_div(F.col(f"{prefix}any2spe"), F.col(f"{prefix}any2dif")))


def calibrate(cb: DataFrame, stats: list[str], method: str = "quantile") -> DataFrame:
    """Lifts dSC to the distribution of dNC and renews omegaC; the former values stay as *_nocalib.

    method: 'quantile' or 'gamma' (a distribution fitted to dNC). Rows in which
    one of the rates isn't finite neither count nor change.
    """
    mapped = {"quantile": quantile_map, "gamma": gamma_map}[method]
    for s in stats:
        n, d, o = f"dNC{s}", f"dSC{s}", f"omegaC{s}"
        cb = mapped(cb, n, d, "_mapped")
        fit = finite(F.col(n)) & finite(F.col(d))
        cb = cb.withColumns({f"{d}_nocalib": F.col(d), f"{o}_nocalib": F.col(o), o: F.when(fit, rate(F.col(n), F.col("_mapped"))).otherwise(F.col(o)), d: F.col("_mapped")}).drop("_mapped")
    return cb


def regression_residual(df: DataFrame, x: str, y: str, out: str) -> DataFrame:
    """y minus the slope of a line through the origin times x (two passes; the slope is one number)."""
    slope = df.agg((F.sum(F.col(x) * F.col(y)) / F.nullif(F.sum(F.col(x) * F.col(x)), F.lit(0.0))).alias("_slope"))
    return df.join(F.broadcast(slope)).withColumn(out, F.col(y) - F.col("_slope") * F.col(x)).drop("_slope")


def g_test(n1, s1, n2, s2):
    """Log-likelihood ratio statistic of the 2x2 table ((n1, s1), (n2, s2)) as a Column, corrected for continuity.

    Each count is moved by up to 0.5 towards its expectation; 0 where the first row has no counts.
    """
    total = n1 + s1 + n2 + s2
    shift = F.least(F.lit(0.5), F.abs(n1 - (n1 + s1) * (n1 + n2) / total)) * F.signum((n1 + s1) * (n1 + n2) / total - n1)
    first = n1 + s1
    n1, s1, n2, s2 = n1 + shift, s1 - shift, n2 - shift, s2 + shift
    term = lambda o, r, c: F.when(o > 0, o * F.ln(o * total / (r * c))).otherwise(0.0)
    g = 2 * (term(n1, n1 + s1, n1 + n2) + term(s1, n1 + s1, s1 + s2) + term(n2, n2 + s2, n1 + n2) + term(s2, n2 + s2, s1 + s2))
    return F.when(first > 0, g).otherwise(0.0)


def g_test_p(n1, s1, n2, s2):
    """p of g_test with one degree of freedom; 1 where the first row has no counts."""
    return F.when(n1 + s1 > 0, chi2_sf(g_test(n1, s1, n2, s2))).otherwise(1.0)


def empirical_p(observed: DataFrame, permuted: DataFrame, keys: list[str], value: str, smoothed: bool = True) -> DataFrame:
    """Share of permuted values at or above the observed one per key; ``smoothed`` adds one to both counts."""
    v = permuted.select(*keys, F.col(value).alias("_v"))
    g = observed.join(v, keys, "left").groupBy(*keys, value).agg(F.count_if(F.col("_v") >= F.col(value)).alias("ge"), F.count("_v").alias("n"))
    one = 1 if smoothed else 0
    return g.withColumn("p", (F.col("ge") + one) / F.nullif(F.col("n") + one, F.lit(0)))


def staged_p(observed: DataFrame, keys: list[str], value: str, draw, schedule: tuple[int, ...] = (100, 1000), edge: int = 5) -> DataFrame:
    """keys, value, ge, n, p of rows against null rounds that are added in stages.

    ``draw`` takes rows (keys) and the first and last number of the rounds, and
    returns keys, round and ``value``. ``schedule``: rounds in all after each
    stage. Only rows with at most ``edge`` rounds at or above their value, whose
    p is still coarse, go on to the next stage. p = (ge + 1) / (n + 1).
    """
    if not schedule or list(schedule) != sorted(set(schedule)) or schedule[0] < 1:
        raise ValueError("the schedule must rise")
    active, done, before = observed.select(*keys, value, F.lit(0).cast("long").alias("ge"), F.lit(0).cast("long").alias("n")), None, 0
    for total in schedule:
        null = draw(active.select(*keys), before + 1, total).select(*keys, F.col(value).alias("_v"))
        met = active.join(null, keys, "left").groupBy(*keys, value, "ge", "n").agg(F.count_if(F.col("_v") >= F.col(value)).alias("_g"), F.count("_v").alias("_k"))
        rows = settled(met.select(*keys, value, (F.col("ge") + F.col("_g")).alias("ge"), (F.col("n") + F.col("_k")).alias("n")))
        coarse = (F.col("ge") <= edge) | (F.col("n") == 0)
        last = total == schedule[-1]
        finished = rows if last else rows.where(~coarse)
        done, active, before = finished if done is None else done.unionByName(finished), rows.where(coarse), total
    return done.withColumn("p", (F.col("ge") + 1) / (F.col("n") + 1))
