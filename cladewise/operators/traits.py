"""Foreground branches, labels of combinations, and their summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import finite
from .combine import ids


def foreground_leaves(leaves: DataFrame, patterns: DataFrame) -> DataFrame:
    """trait, lineage, name: leaves whose whole name matches a pattern (patterns are few; matching is anchored on both ends)."""
    return leaves.join(F.broadcast(patterns), F.expr("rlike(name, concat('\\\\A(?:', pattern, ')\\\\z'))")).select("trait", "lineage", "name").distinct()


def background_value(c):
    """True for the trait values that mean background: null, blank, zero, NaN, false."""
    t = F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))
    return (t == "") | t.rlike(r"\A[+-]?0+(\.0+)?\z") | t.isin("nan", "false")


def lineage_branches(leaves: DataFrame, closure: DataFrame, n_leaves: DataFrame) -> DataFrame:
    """trait, lineage, branch_id: branches whose leaves are all of the lineage.

    leaves: trait, lineage, leaf; closure: anc, leaf (each node with its leaves,
    a leaf with itself); n_leaves: anc, n.
    """
    hit = leaves.join(closure, "leaf").groupBy("trait", "lineage", "anc").agg(F.count_distinct("leaf").alias("k"))
    return hit.join(n_leaves, "anc").where("k = n").select("trait", "lineage", F.col("anc").alias("branch_id"))


def stem_branches(lineage: DataFrame, parents: DataFrame) -> DataFrame:
    """Lineage branches whose parent is not of the lineage."""
    inner = lineage.select("trait", "lineage", F.col("branch_id").alias("parent"))
    return lineage.join(parents, lineage.branch_id == parents.node).drop("node").join(inner, ["trait", "lineage", "parent"], "left_anti").select("trait", "lineage", "branch_id")


def marginal_branches(stems: DataFrame, parents: DataFrame) -> DataFrame:
    """trait, branch_id: parents and sisters of stem branches that aren't stems of the trait themselves."""
    s = stems.select("trait", F.col("branch_id").alias("node")).join(parents, "node")
    sisters = s.select("trait", "parent", F.col("node").alias("own")).join(parents, "parent").where("node <> own").select("trait", F.col("node").alias("branch_id"))
    up = s.where("parent is not null").select("trait", F.col("parent").alias("branch_id"))
    return up.union(sisters).distinct().join(stems.select("trait", "branch_id"), ["trait", "branch_id"], "left_anti")


def label_combinations(cb: DataFrame, k: int, fg: DataFrame, mg: DataFrame | None = None) -> DataFrame:
    """branch_num_fg, branch_num_mg, is_fg (all members), is_mg (all marginal), is_mf (both kinds, no others).

    fg and mg: branch_id of one trait; they are short and broadcast.
    """
    for kind, table in (("fg", fg), ("mg", mg)):
        if table is None:
            cb = cb.withColumn(f"branch_num_{kind}", F.lit(0))
            continue
        members = F.lit(0)
        for c in ids(k):
            flag = F.broadcast(table.select(F.col("branch_id").alias(c)).distinct().withColumn(f"_{kind}_{c}", F.lit(1)))
            cb = cb.join(flag, c, "left")
            members = members + F.coalesce(F.col(f"_{kind}_{c}"), F.lit(0))
        cb = cb.withColumn(f"branch_num_{kind}", members).drop(*[f"_{kind}_{c}" for c in ids(k)])
    f, m = F.col("branch_num_fg"), F.col("branch_num_mg")
    return cb.withColumns({"is_fg": f == k, "is_mg": m == k, "is_mf": (f > 0) & (m > 0) & (f + m == k)})


def label_branches(b: DataFrame, fg: DataFrame, mg: DataFrame) -> DataFrame:
    """Adds is_fg_<trait> and is_mg_<trait> ('Y' or 'N') to a table of branches for every trait of fg and mg (trait, branch_id)."""
    traits = sorted({r.trait for r in fg.select("trait").union(mg.select("trait")).distinct().collect()})  # a few
    own = None
    for kind, table in (("fg", fg), ("mg", mg)):
        part = table.select("branch_id", F.concat(F.lit(f"is_{kind}_"), F.col("trait")).alias("c"))
        own = part if own is None else own.unionByName(part)
    names = [f"is_{k}_{t}" for t in traits for k in ("fg", "mg")]
    flags = own.groupBy("branch_id").agg(*[F.bool_or(F.col("c") == n).alias(n) for n in names])
    return b.join(flags, "branch_id", "left").withColumns({n: F.when(F.col(n), "Y").otherwise("N") for n in names})


def summarise(cb: DataFrame, stats: list[str], passed, targets: list[str]) -> DataFrame:
    """One row: numbers of combinations, of passing ones, medians and totals of each statistic for all and each target flag.

    Medians skip NaN and keep infinite values; ``passed`` is a Column.
    """
    out = [F.count(F.lit(1)).alias("num_all"), F.count_if(passed).alias("num_qualified_all")]
    for t in targets:
        flag = F.col(t)
        out += [F.count_if(flag).alias(f"num_{t}"), F.count_if(flag & passed).alias(f"num_qualified_{t}")]
        share = lambda a, b: F.try_divide(a.cast("double"), b)
        out.append(F.try_divide(share(F.count_if(flag & passed), F.count_if(passed)), share(F.count_if(flag), F.count(F.lit(1)))).alias(f"enrichment_{t}"))
    for s in stats:
        v = F.when(~F.isnan(s), F.col(s))
        for t, use in [("all", F.lit(True)), *[(t, F.col(t)) for t in targets]]:
            out += [F.percentile(F.when(use, v), 0.5).alias(f"median_{s}_{t}"), F.sum(F.when(use & finite(F.col(s)), F.col(s))).alias(f"total_{s}_{t}")]
    return cb.agg(*out)
