"""The event fact table and what is summed from it.

events: branch_id, site, grp, a, d, pp - the posterior probability that on a
branch, at a site and within a group, state a became state d (a and d differ).
Zero entries are absent.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.numeric import significant

#: Features that each statistic keeps of (grp, a, d).
FEATURES = {"any2any": ["grp"], "spe2any": ["grp", "a"], "any2spe": ["grp", "d"], "spe2spe": ["grp", "a", "d"]}


def substitution_events(posterior: DataFrame, parents: DataFrame, groups: DataFrame, min_pp: float = 0.0) -> DataFrame:
    """Events from state posteriors (node, site, state, p): P(parent, a) * P(child, d).

    ``parents`` (node, parent) names the nearest ancestor that has states;
    ``groups`` (state, grp) confines events to one group, as synonymous ones
    are; give all states one group for the others. Every (branch, site) pairs
    its parent's and own states, so rows are bounded by states squared.
    """
    p = posterior.join(F.broadcast(groups), "state")
    own = p.join(F.broadcast(parents), "node").select(F.col("node").alias("branch_id"), F.col("parent"), "site", "grp", F.col("state").alias("d"), F.col("p").alias("pd"))
    up = p.select(F.col("node").alias("parent"), "site", "grp", F.col("state").alias("a"), F.col("p").alias("pa"))
    e = own.join(up, ["parent", "site", "grp"]).where("a <> d").withColumn("pp", F.col("pa") * F.col("pd"))
    return at_least_pp(e.select("branch_id", "site", "grp", "a", "d", "pp"), min_pp)


def at_least_pp(events: DataFrame, min_pp: float) -> DataFrame:
    """Events with pp of at least ``min_pp``, and never those with none."""
    return events.where((F.col("pp") >= min_pp) & (F.col("pp") > 0))


def project(events: DataFrame, stat: str) -> DataFrame:
    """Sums over the states that ``stat`` doesn't tell apart: branch_id, site, its features, v."""
    return events.groupBy("branch_id", "site", *FEATURES[stat]).agg(F.sum("pp").alias("v"))


def projections(events: DataFrame, stats=tuple(FEATURES)) -> DataFrame:
    """branch_id, site, stat, grp, a, d, v: the sums of ``project`` for several statistics in one pass; states a statistic doesn't tell apart are ''."""
    whole = events.groupBy("branch_id", "site", "grp", F.col("a").cast("string").alias("a"), F.col("d").cast("string").alias("d")).agg(F.sum("pp").alias("pp"))
    kept = F.array(*[F.struct(F.lit(s).alias("stat"), *[(F.col(c) if c in FEATURES[s] else F.lit("")).alias(c) for c in "ad"]) for s in stats])
    each = whole.select("branch_id", "site", "grp", "pp", F.explode(kept).alias("k"))
    return each.groupBy("branch_id", "site", F.col("k.stat").alias("stat"), "grp", F.col("k.a").alias("a"), F.col("k.d").alias("d")).agg(F.sum("pp").alias("v"))


def branch_totals(events: DataFrame, branches: DataFrame | None = None, name: str = "sub") -> DataFrame:
    """Total per branch; with ``branches`` (branch_id), also of those without events."""
    t = events.groupBy("branch_id").agg(F.sum("pp").alias(name))
    return t if branches is None else branches.select("branch_id").join(t, "branch_id", "left").fillna(0.0, [name])


def site_totals(events: DataFrame, sites: DataFrame | None = None, name: str = "sub") -> DataFrame:
    t = events.groupBy("site").agg(F.sum("pp").alias(name))
    return t if sites is None else sites.select("site").join(t, "site", "left").fillna(0.0, [name])


def branch_site_totals(events: DataFrame, branches: DataFrame, sites: DataFrame, name: str = "sub") -> DataFrame:
    """Totals on the full axes of branches and sites (both short: a tree and an alignment)."""
    axes = sites.select("site").crossJoin(F.broadcast(branches.select("branch_id")))
    t = events.groupBy("branch_id", "site").agg(F.sum("pp").alias(name))
    return axes.join(t, ["branch_id", "site"], "left").fillna(0.0, [name]).select("branch_id", "site", name)


def group_state_totals(events: DataFrame) -> DataFrame:
    """Totals of (grp, a, d), (grp, a) and (grp, d) in one pass; level says which."""
    g = F.grouping_id().alias("level")
    return events.groupingSets([["grp", "a", "d"], ["grp", "a"], ["grp", "d"]], "grp", "a", "d").agg(F.sum("pp").alias("total"), g)


def sitewise_changes(events: DataFrame, min_pp: float = 0.5) -> DataFrame:
    """Per branch the likeliest change of each site with pp of at least ``min_pp``, as 'A12G,C31T' by site (1-based).

    Equal pp: the smaller a, then d, unknown (null) ones last. A site whose best change has an unknown state is left out; null if all are.
    """
    w = Window.partitionBy("branch_id", "site").orderBy(F.desc("pp"), F.asc_nulls_last("a"), F.asc_nulls_last("d"))
    best = events.where(F.col("pp") >= min_pp).withColumn("r", F.row_number().over(w)).where("r = 1")
    one = F.struct("site", F.concat("a", (F.col("site") + 1).cast("string"), "d").alias("x"))
    changes = F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s.x), ",")
    return best.groupBy("branch_id").agg(F.nullif(changes, F.lit("")).alias("changes"))


def state_distribution(events: DataFrame, keys: list[str], state: str) -> DataFrame:
    """'A:1.9,G:0.7' per key: mass of each state in at most six significant digits, largest first."""
    m = events.groupBy(*keys, state).agg(F.sum("pp").alias("m"))
    one = F.struct((-F.col("m")).alias("n"), F.col(state).alias("s"), F.concat(F.col(state).cast("string"), F.lit(":"), significant(F.col("m"))).alias("x"))
    return m.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda s: s.x), ",").alias("distribution"))


def zero_mass_sites(events: DataFrame, sites: DataFrame, tol: float = 1e-9) -> DataFrame:
    """Sites whose events sum to nothing."""
    return sites.select("site").join(site_totals(events).where(F.col("sub") > tol), "site", "left_anti")


def reindex_sites(sites: DataFrame) -> DataFrame:
    """site, new: sites that are kept, numbered from 0 in their order (an alignment's sites are few thousands)."""
    return sites.select("site").distinct().withColumn("new", F.row_number().over(Window.orderBy("site")) - 1)


def invariant_tip_sites(states: DataFrame) -> DataFrame:
    """Sites with an unambiguous state (candidates = 1) in some tip, the same in all such, and no ambiguous tip (candidates > 1).

    states: site, tip, state, candidates (0 for a gap).
    """
    seen = F.count_if(F.col("candidates") == 1)
    g = states.groupBy("site").agg(seen.alias("n"), F.max("candidates").alias("m"), F.count_distinct(F.when(F.col("candidates") == 1, F.col("state"))).alias("k"))
    return g.where("n > 0 and m <= 1 and k = 1").select("site")


def most_likely_states(posterior: DataFrame, keys: list[str]) -> DataFrame:
    """The likeliest state of each key (ties to the smaller state); keys without mass drop out."""
    best = F.max_by("state", F.struct("p", F.expr("-ord")))
    ranked = posterior.where("p > 0").withColumn("ord", F.dense_rank().over(Window.partitionBy(*keys).orderBy("state")))
    return ranked.groupBy(*keys).agg(best.alias("state"), F.max("p").alias("p"))
