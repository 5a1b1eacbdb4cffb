"""Sums over axes of the event table, column statistics of alignments, and summaries of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.numeric import finite

AXES = ("branch_id", "site", "grp", "a", "d")


def axis_sums(events: DataFrame, over: tuple[str, ...] = (), name: str = "total") -> DataFrame:
    """Events summed over the axes named: what is left of branch_id, site, grp, a and d are the keys."""
    if set(over) - set(AXES):
        raise ValueError(f"axes are {', '.join(AXES)}")
    keys = [c for c in AXES if c not in over]
    return events.groupBy(*keys).agg(F.sum("pp").alias(name)) if keys else events.agg(F.sum("pp").alias(name))


def two_way(projection: DataFrame, features: list[str]) -> tuple[DataFrame, DataFrame]:
    """Totals of a projection by (branch_id, features) and by (site, features)."""
    return tuple(projection.groupBy(axis, *features).agg(F.sum("v").alias("total")) for axis in ("branch_id", "site"))


def aggregate_branches(events: DataFrame, branches: DataFrame, operation: str = "sum") -> DataFrame:
    """site, grp, a, d, v over the given branches (branch_id): a sum, or a product, which is 0 unless every branch has the event."""
    e = events.join(F.broadcast(branches.select("branch_id").distinct()), "branch_id").groupBy("branch_id", "site", "grp", "a", "d").agg(F.sum("pp").alias("pp"))
    keys = ["site", "grp", "a", "d"]
    if operation == "sum":
        return e.groupBy(*keys).agg(F.sum("pp").alias("v"))
    if operation != "product":
        raise ValueError("operation is sum or product")
    k = branches.agg(F.count_distinct("branch_id").alias("_k"))
    return e.groupBy(*keys).agg(F.product("pp").alias("v"), F.count(F.lit(1)).alias("_n")).join(F.broadcast(k)).where("_n = _k").select(*keys, "v")


def change_totals(events: DataFrame, states: DataFrame) -> DataFrame:
    """grp, a, d, total for every ordered pair of different states (grp, state) of a group, 0 without events."""
    axes = states.select("grp", F.col("state").alias("a")).join(states.select("grp", F.col("state").alias("d")), "grp").where("a <> d")
    return axes.join(events.groupBy("grp", "a", "d").agg(F.sum("pp").alias("total")), ["grp", "a", "d"], "left").fillna(0.0, ["total"])


def farthest_changes(events: DataFrame, distances: DataFrame, lengths: DataFrame, least: float = 0.5) -> DataFrame:
    """grp, a, d, dist: the largest distance between two branches that have at least ``least`` of a change, the second one's own length taken off.

    distances: x, y, dist with x < y; lengths: branch_id, length.
    """
    keys = ["grp", "a", "d"]
    have = events.groupBy("branch_id", *keys).agg(F.sum("pp").alias("m")).where(F.col("m") >= least)
    x, y = have.select(F.col("branch_id").alias("x"), *keys), have.select(F.col("branch_id").alias("y"), *keys)
    both = x.join(y, keys).where("x < y").join(distances, ["x", "y"]).join(F.broadcast(lengths.select(F.col("branch_id").alias("y"), "length")), "y")
    far = both.groupBy(*keys).agg(F.max(F.col("dist") - F.col("length")).alias("dist"))
    return events.select(*keys).distinct().join(far, keys, "left")


def transition_matrix(residues: DataFrame, states: DataFrame, pseudo: float = 1e-12) -> DataFrame:
    """a, d, q: how often two sequences differ so at a site, as shares of a's row, from residues (site, state).

    A site with n of one and m of another state counts n * m both ways.
    """
    n = residues.groupBy("site", "state").agg(F.count(F.lit(1)).alias("n"))
    x, y = n.select("site", F.col("state").alias("a"), F.col("n").alias("na")), n.select("site", F.col("state").alias("d"), F.col("n").alias("nd"))
    pairs = x.join(y, "site").where("a <> d").groupBy("a", "d").agg(F.sum(F.col("na") * F.col("nd")).cast("double").alias("k"))
    s = F.broadcast(states.select("state").distinct())
    axes = s.select(F.col("state").alias("a")).join(F.broadcast(s.select(F.col("state").alias("d"))), F.col("a") != F.col("d"))
    full = axes.join(pairs, ["a", "d"], "left").fillna(0.0, ["k"]).withColumn("k", F.col("k") + pseudo)
    return full.select("a", "d", (F.col("k") / F.sum("k").over(Window.partitionBy("a"))).alias("q"))


def state_frequencies(residues: DataFrame, states: DataFrame, pseudo: float = 1e-12) -> tuple[DataFrame, DataFrame]:
    """(seq_id, state, freq, valid) of each sequence, and (state, freq) of all together, from residues (seq_id, site, state)."""
    n = residues.groupBy("seq_id", "state").agg(F.count(F.lit(1)).alias("n"))
    own = n.withColumn("valid", F.sum("n").over(Window.partitionBy("seq_id"))).select("seq_id", "state", (F.col("n") / F.col("valid")).alias("freq"), "valid")
    pooled = states.select("state").distinct().join(n.groupBy("state").agg(F.sum("n").cast("double").alias("n")), "state", "left").fillna(0.0, ["n"]).withColumn("n", F.col("n") + pseudo)
    total = pooled.agg(F.sum("n").alias("_t"))
    return own, pooled.join(F.broadcast(total)).select("state", (F.col("n") / F.col("_t")).alias("freq"))


def run_summary(rows: DataFrame, keys: list[str], score: str, count: str, least_score: float, least_count: float) -> DataFrame:
    """keys, n_rows, n_finite, max_score, median_score (finite ones) and n_hits (score and count reach their least values)."""
    s = F.when(finite(F.col(score)), F.col(score))
    hit = (F.col(score) >= least_score) & ~F.isnan(score) & (F.col(count) >= least_count)
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count(s).alias("n_finite"), F.max(s).alias("max_score"), F.median(s).alias("median_score"), F.count_if(hit).alias("n_hits"))


def parameter_summary(runs: DataFrame, parameters: list[str], metrics: list[str]) -> DataFrame:
    """parameter, value, n and the mean, median, min and max of each metric over the runs with that value."""
    long = runs.select(F.explode(F.array(*[F.struct(F.lit(p).alias("parameter"), F.col(p).cast("string").alias("value")) for p in parameters])).alias("p"), *metrics)
    each = [f(m).alias(f"{n}_{m}") for m in metrics for n, f in (("mean", F.avg), ("median", F.median), ("min", F.min), ("max", F.max))]
    return long.where("p.value is not null").groupBy("p.parameter", "p.value").agg(F.count(F.lit(1)).alias("n"), *each)


def rescaled_lengths(events: DataFrame, present: DataFrame, parents: DataFrame, floor: float = 0.0) -> DataFrame:
    """branch_id, subs, codons, length: substitutions per site that the branch's node or its parent has.

    present: node, site (not missing); parents: node, parent.
    """
    ends = parents.select(F.col("node").alias("branch_id"), F.explode(F.array("node", "parent")).alias("node"))
    both = ends.join(present, "node").groupBy("branch_id").agg(F.count_distinct("site").alias("codons"))
    subs = events.groupBy("branch_id").agg(F.sum("pp").alias("subs"))
    out = parents.select(F.col("node").alias("branch_id")).join(subs, "branch_id", "left").join(both, "branch_id", "left").fillna(0, ["subs", "codons"])
    return out.withColumn("length", F.when(F.col("codons") > 0, F.greatest(F.col("subs") / F.col("codons"), F.lit(floor))).otherwise(F.lit(0.0)))


def site_rates(totals: dict[str, DataFrame], mode: str, sites: int, present: DataFrame, alpha: float = 0.0, file_rates: DataFrame | None = None) -> dict[str, DataFrame]:
    """branch_id, site, weight by channel: how a branch's substitutions spread over the sites that it has (present: branch_id, site).

    totals: site, sub of each channel. Modes: 'no' (all alike), 'pool' (both
    channels together), 'sn' (each channel's own), 'file' (given rates), 'each'
    (each feature's own: totals then have stat, grp, a and d, and so have the
    weights); alpha is added to each site's share in 'sn' and 'each'. Where a branch's sites have no
    weight at all they are alike.
    """
    every = None
    for df in totals.values():
        every = df if every is None else every.unionByName(df)
    if mode == "no":
        base = {c: present.select("site").distinct().withColumn("sub", F.lit(1.0 / sites)) for c in totals}
    elif mode == "pool":
        base = dict.fromkeys(totals, every.groupBy("site").agg(F.sum("sub").alias("sub")))
    elif mode == "sn" or mode == "each" and all({"stat", "grp", "a", "d"} <= set(df.columns) for df in totals.values()):
        base = totals
    elif mode == "file" and file_rates is not None:
        base = dict.fromkeys(totals, file_rates.select("site", F.col("rate").alias("sub")))
    else:
        raise ValueError(f"unknown site rate mode {mode!r}, or not what it needs")
    added = alpha if mode in ("sn", "each") else 0.0
    feature = ["stat", "grp", "a", "d"] if mode == "each" else []
    w = Window.partitionBy("branch_id", *feature)

    def spread(df):
        own = present.select("branch_id", "site")
        if feature:  # a branch's sites, for each feature that its channel has (a few dozen)
            own = own.join(F.broadcast(df.select(*feature).distinct()))
        rows = own.join(df.select("site", *feature, "sub"), ["site", *feature], "left").fillna(0.0, ["sub"]).withColumn("_s", F.greatest(F.col("sub"), F.lit(0.0)) + added)
        rows = rows.withColumns({"_t": F.sum("_s").over(w), "_n": F.count(F.lit(1)).over(w)})
        return rows.select("branch_id", "site", *feature, F.when(F.col("_t") > 0, F.col("_s") / F.col("_t")).otherwise(1.0 / F.col("_n")).alias("weight"))

    return {c: spread(df) for c, df in base.items()}
