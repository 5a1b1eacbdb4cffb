"""State posteriors of tree nodes: projections to groups, missing sites, effective parents, likeliest sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def shares(weights: DataFrame, keys: list[str], state: str, value: str) -> DataFrame:
    """keys, state, p: each state's share of its key's weight (rows of one state are summed; keys without weight give no rows)."""
    w = weights.groupBy(*keys, F.col(state).alias("state")).agg(F.sum(value).alias("w"))
    return w.withColumn("_t", F.sum("w").over(Window.partitionBy(*keys))).where("w > 0").select(*keys, "state", (F.col("w") / F.col("_t")).alias("p"))


def project_states(posterior: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """keys, state, p with states (of codons, say) summed to the groups (amino acids, recoded classes) of groups (state, grp)."""
    return posterior.join(F.broadcast(groups), "state").groupBy(*keys, F.col("grp").alias("state")).agg(F.sum("p").alias("p"))


def vectors(posterior: DataFrame, keys: list[str], states: int) -> DataFrame:
    """keys, p: an array over states 0 .. states - 1, 0 where a state has no row."""
    m = posterior.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("state").cast("int"), "p"))).alias("m"))
    return m.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(states - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0))).alias("p"))


def project_rates(rates: DataFrame, groups: DataFrame) -> DataFrame:
    """a, d, rate between groups: sums of the rates (a, d, rate) between their states; the diagonal makes each row sum to 0."""
    g = F.broadcast(groups)
    r = rates.join(g.select(F.col("state").alias("a"), F.col("grp").alias("ga")), "a").join(g.select(F.col("state").alias("d"), F.col("grp").alias("gd")), "d")
    off = r.where("ga <> gd").groupBy(F.col("ga").alias("a"), F.col("gd").alias("d")).agg(F.sum("rate").alias("rate"))
    return off.unionByName(off.groupBy("a").agg((-F.sum("rate")).alias("rate")).select("a", F.col("a").alias("d"), "rate"))


def ancestors(nodes: DataFrame) -> DataFrame:
    """node, ancestor, depth (1 for the parent) of every node of nodes (node, parent; null for the root): one join a doubling of the depth."""
    up = nodes.where("parent is not null").select("node", F.col("parent").alias("ancestor"), F.lit(1).alias("depth"))
    closed, reach = up, 1
    while True:
        x, y = closed.where(F.col("depth") == reach), closed.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("top"), F.col("depth").alias("more"))
        further = x.join(y, "ancestor").select("node", F.col("top").alias("ancestor"), (F.col("depth") + F.col("more")).alias("depth"))
        if not further.limit(1).count():
            return closed
        closed, reach = closed.unionByName(further), 2 * reach


def effective_parents(nodes: DataFrame, with_states: DataFrame) -> DataFrame:
    """node, parent: the nearest ancestor that has states (node), for nodes that have states or are leaves; nodes without such an ancestor drop out."""
    stated = F.broadcast(with_states.select("node").distinct())
    leaves = nodes.select("node").join(nodes.select(F.col("parent").alias("node")), "node", "left_anti")
    own = nodes.select("node").join(stated, "node", "left_semi").union(leaves).distinct()
    up = ancestors(nodes).join(stated.select(F.col("node").alias("ancestor")), "ancestor", "left_semi")
    return up.groupBy("node").agg(F.min_by("ancestor", "depth").alias("parent")).join(own, "node", "left_semi")


def informative_sites(nodes: DataFrame, present: DataFrame) -> DataFrame:
    """node, site of inner nodes (not the root) where two or more of the neighbour clades, children's and sisters', have an informative leaf.

    nodes: node, parent; present: leaf, site, one row for each site that a leaf has.
    """
    up = nodes.where("parent is not null").select("node", "parent")
    inner = up.join(nodes.select(F.col("parent").alias("node")).distinct(), "node", "left_semi")
    children = up.select(F.col("parent").alias("node"), F.col("node").alias("clade")).join(inner.select("node"), "node", "left_semi")
    sisters = inner.join(up.select("parent", F.col("node").alias("clade")), "parent").where("node <> clade").select("node", "clade")
    below = ancestors(nodes).select(F.col("ancestor").alias("clade"), F.col("node").alias("leaf")).unionByName(nodes.select(F.col("node").alias("clade"), F.col("node").alias("leaf")))
    clade_sites = below.join(present.select("leaf", "site").distinct(), "leaf").select("clade", "site").distinct()
    return children.unionByName(sisters).join(clade_sites, "clade").groupBy("node", "site").agg(F.count_distinct("clade").alias("n")).where("n >= 2").select("node", "site")


def state_strings(best: DataFrame, sites: int, missing: str = "-") -> DataFrame:
    """node, sequence: the likeliest state (node, site, state) of each of the sites 0 .. sites - 1, ``missing`` where there is none."""
    m = best.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("site", F.col("state").cast("string")))).alias("m"))
    one = F.transform(F.sequence(F.lit(0), F.lit(sites - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(missing)))
    return m.select("node", F.array_join(one, "").alias("sequence"))
