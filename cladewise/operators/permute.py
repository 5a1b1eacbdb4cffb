"""Permutation nulls: random foreground clades, calibrated scan p-values, random combinations.

A permutation is one more key: what doesn't depend on it is summed once, and
the permuted sets of branches are joined to those sums.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.settled import settled
from .combine import ids
from .scan import KEYS


def clade_bins(sizes: Iterable[int], least: int) -> list[int]:
    """Lower bounds of clade size bins, largest first, the first entry being above all sizes.

    Sizes are taken from the largest down until ``least`` clades are in a bin;
    sizes that don't fill a last bin belong to none. Without any full bin the
    smallest and the largest size are returned.
    """
    count = pd.Series(list(sizes), dtype="int64").value_counts().sort_index(ascending=False)
    if not len(count):
        return [0, 0]
    bins, held = [int(count.index[0]) + 1], 0
    for size, n in count.items():
        held += int(n)
        if held >= least:
            bins.append(int(size))
            held = 0
    return bins if len(bins) > 1 else [int(count.index[-1]), int(count.index[0])]


def _draw_stems(size: np.ndarray, below: np.ndarray, stem: np.ndarray, bounds: list[int], original: bool, rng, attempts: int = 100) -> np.ndarray | None:
    """One random set of stems: as many of each size bin as there are, none within another. ``below[i, j]``: j is below i."""
    bin_of = np.searchsorted(-np.array(bounds), -size, side="left")
    bin_of[(size < bounds[-1]) & (bin_of == len(bounds))] = -1
    for _ in range(attempts):
        chosen, free = np.zeros(len(size), bool), np.ones(len(size), bool) if original else ~stem
        for k in sorted({int(b) for b in bin_of[stem]}):  # larger clades first
            for _ in range(int((bin_of[stem] == k).sum())):
                able = np.flatnonzero(free & (bin_of == k))
                if not len(able):
                    break
                pick = int(rng.choice(able))
                chosen[pick] = True
                free &= ~(below[pick] | below[:, pick])
                free[pick] = False
            else:
                continue
            break
        else:
            return chosen
    return None


def random_stems(spark: SparkSession, nodes: list[tuple[int, int | None, int]], stems: set[int], rounds: int, least: int = 10, original: bool = False, seed: int = 1) -> DataFrame:
    """round, branch_id: random foreground stems of each round, alike in clade size to the given ones.

    nodes: (branch_id, parent, clade size) of a tree, which is small and goes to
    every task; rounds are spread. A round that finds no set of clades that
    don't overlap has no rows. ``original``: the given stems may be drawn too.
    """
    ids_ = np.array([n[0] for n in nodes])
    at, parent = {int(b): i for i, b in enumerate(ids_)}, {n[0]: n[1] for n in nodes}
    below = np.zeros((len(nodes), len(nodes)), bool)
    for b in parent:
        up = parent[b]
        while up is not None and up in at:
            below[at[up], at[b]] = True
            up = parent.get(up)
    size, stem = np.array([n[2] for n in nodes]), np.isin(ids_, list(stems))
    bounds = clade_bins(size if original else size[~stem], least)

    def run(batches):
        for pdf in batches:
            for r in pdf["round"]:
                chosen = _draw_stems(size, below, stem, bounds, original, np.random.default_rng([seed, int(r)]))
                if chosen is not None:
                    yield pd.DataFrame({"round": r, "branch_id": ids_[chosen]}).astype({"round": "int64", "branch_id": "int64"})

    return spark.range(1, rounds + 1).select(F.col("id").alias("round")).mapInPandas(run, "round long, branch_id long")


def permuted_enrichment(mass: DataFrame, rounds: DataFrame, branches: DataFrame) -> DataFrame:
    """KEYS, round, lrt of the candidates that have mass on a round's targets (candidate_fixed); in all other rounds their statistic is 0.

    mass: KEYS, branch_id, m; rounds: round, branch_id of the targets; branches:
    branch_id, exposure. A candidate's sums over all branches are made once, a
    round adds up its targets only; the statistic is 0 where their rate isn't
    the larger, null where targets or others have no exposure.
    """
    whole = mass.join(branches, "branch_id").groupBy(*KEYS).agg(F.sum("m").alias("all_x"))
    hit = mass.join(rounds.join(branches.select("branch_id"), "branch_id", "left_semi"), "branch_id").groupBy(*KEYS, "round").agg(F.sum("m").alias("xt"))
    j = hit.join(whole, KEYS).join(round_lengths(rounds, branches), "round")
    return j.select(*KEYS, "round", larger_rate_statistic(F.col("xt"), F.greatest(F.col("all_x") - F.col("xt"), F.lit(0.0)), F.col("lt"), F.col("lo")).alias("lrt"))


def round_lengths(rounds: DataFrame, branches: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """round, lt, lo: exposure of each round's targets (round, branch_id) and of all other branches, or of ``others`` that are no targets."""
    lt = rounds.join(branches, "branch_id").groupBy("round").agg(F.sum("exposure").alias("lt"))
    if others is None:
        total = branches.agg(F.sum("exposure").alias("all_l"))
        return lt.join(F.broadcast(total)).select("round", "lt", (F.col("all_l") - F.col("lt")).alias("lo"))
    lo = others.join(branches, "branch_id").groupBy("round").agg(F.sum("exposure").alias("lo"))
    return lt.join(lo, "round", "left").fillna(0.0, ["lo"])


def larger_rate_statistic(xt: Column, xo: Column, lt: Column, lo: Column) -> Column:
    """Likelihood ratio of two rates against one, 0 unless the first is the larger; null without exposure on either side."""
    pooled = (xt + xo) / (lt + lo)
    term = lambda x, n: F.when(x > 0, x * F.ln(x / (n * pooled))).otherwise(0.0)
    return F.when((lt > 0) & (lo > 0), F.when(xt * lo > xo * lt, F.greatest(F.lit(0.0), 2 * (term(xt, lt) + term(xo, lo)))).otherwise(0.0))


def observed_enrichment(mass: DataFrame, targets: DataFrame, branches: DataFrame) -> DataFrame:
    """KEYS, lrt of every candidate for one set of targets (branch_id)."""
    own = permuted_enrichment(mass, targets.select(F.lit(0).alias("round"), "branch_id"), branches).drop("round")
    return mass.select(*KEYS).distinct().join(own, KEYS, "left").fillna(0.0, ["lrt"])


def calibrated(observed: DataFrame, permuted: DataFrame, rounds: int, digits: int = 9, fixed: bool = True) -> DataFrame:
    """Adds empirical, (1 + rounds in which the candidate's own statistic is as large) / (1 + rounds), and empirical_max, the same against each round's largest.

    observed and permuted: KEYS and lrt (p falls with it), permuted also round.
    ``rounds``: those that were drawn. ``fixed``: all candidates are in every
    round, with a statistic of 0 where there is no row; else (full_scan) one
    that a round doesn't have is not as large. A round without rows has a
    largest of 0. Statistics are compared to ``digits`` places; null where the
    observed one is null or no round was drawn.
    """
    lrt = lambda c: F.round(c, digits)
    own = permuted.select(*KEYS, F.col("lrt").alias("_p"))
    ge = observed.select(*KEYS, F.col("lrt").alias("_o")).join(own, KEYS, "left").groupBy(*KEYS).agg(F.count_if(lrt("_p") >= lrt("_o")).alias("_ge"))
    top = permuted.groupBy("round").agg(F.coalesce(F.max("lrt"), F.lit(0.0)).alias("m")).agg(F.collect_list("m").alias("_tops"))  # a number a round
    j = observed.join(ge, KEYS).join(F.broadcast(top))
    nothing = lrt("lrt") <= 0
    over = F.size(F.filter("_tops", lambda m: F.round(m, digits) >= lrt("lrt"))) + F.when(nothing, rounds - F.size("_tops")).otherwise(0)
    share = lambda n: F.when(F.col("lrt").isNotNull() & (F.lit(rounds) > 0), F.least(F.lit(1.0), (n + 1) / F.lit(1.0 + rounds)))
    ge = F.when(nothing, rounds).otherwise(F.col("_ge")) if fixed else F.col("_ge")
    return j.withColumns({"empirical": share(ge), "empirical_max": share(over)}).drop("_ge", "_tops")


def permuted_summary(cb: DataFrame, k: int, rounds: DataFrame, value: str) -> DataFrame:
    """round, n, median, total of ``value`` over the combinations whose members are all foreground branches of a round.

    A combination meets a round through its first member, and stays if all of
    its members are among the round's.
    """
    hit = cb.select(*ids(k), value)
    for c in ids(k):
        r = rounds.select("round", F.col("branch_id").alias(c))
        hit = hit.join(r, c) if c == ids(k)[0] else hit.join(r, ["round", c])
    number = F.when(~F.isnan(value), F.col(value))
    return hit.groupBy("round").agg(F.count(F.lit(1)).alias("n"), F.median(number).alias("median"), F.sum(number).alias("total"))


def summary_p(permuted: DataFrame, observed: float, value: str = "median") -> DataFrame:
    """n, as_large, p, median, mean, sd: rounds whose ``value`` is known, those at or above the observed one, their share, and the finite values' mean and deviation."""
    v = F.col(value)
    known, inside = v.isNotNull() & ~F.isnan(v), v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    n, large = F.count_if(known), F.count_if(known & (v >= F.lit(float(observed))))
    return permuted.agg(n.alias("n"), large.alias("as_large"), F.try_divide(large, n).alias("p"), F.median(F.when(known, v)).alias("median"), F.avg(F.when(inside, v)).alias("mean"), F.stddev_pop(F.when(inside, v)).alias("sd"))


def random_combinations(spark: SparkSession, branches: list[int], dependent: set[tuple[int, int]], k: int, n: int, seed: int = 1, rounds: int = 20) -> DataFrame:
    """Up to ``n`` different random combinations of ``k`` branches of which no two depend on each other.

    Each attempt draws its members one by one among those that are still
    independent (a tree's branches are few and go to every task); attempts are
    spread, and more are made until there are enough or ``rounds`` are over.
    """
    every = np.array(sorted(branches))
    conflict = np.eye(len(every), dtype=bool)
    at = {int(b): i for i, b in enumerate(every)}
    for x, y in dependent:
        if x in at and y in at:
            conflict[at[x], at[y]] = conflict[at[y], at[x]] = True

    def run(batches):
        for pdf in batches:
            out = []
            for i in pdf["id"]:
                rng, free, members = np.random.default_rng([seed, int(i)]), np.ones(len(every), bool), []
                while free.any() and len(members) < k:
                    members.append(int(rng.choice(np.flatnonzero(free))))
                    free &= ~conflict[members[-1]]
                if len(members) == k:
                    out.append([int(i), *every[sorted(members)].tolist()])
            if out:
                yield pd.DataFrame(out, columns=["attempt", *ids(k)])

    schema = "attempt long, " + ", ".join(f"{c} long" for c in ids(k))
    found, done, step = None, 0, max(2 * n, 100)
    for _ in range(rounds):
        drawn = spark.range(done, done + step).mapInPandas(run, schema)
        found = settled((drawn if found is None else found.unionByName(drawn)).groupBy(*ids(k)).agg(F.min("attempt").alias("attempt")))
        done += step
        if found.count() >= n:
            break
    return found.orderBy("attempt").limit(n).select(*ids(k))


def known_rows(requested: DataFrame, known: DataFrame, k: int, compute) -> DataFrame:
    """Rows of ``known`` for the requested combinations; those it lacks are computed (``compute``: combinations to rows) and added."""
    missing = requested.select(*ids(k)).distinct().join(known.select(*ids(k)), ids(k), "left_anti")
    return known.join(requested.select(*ids(k)).distinct(), ids(k), "left_semi").unionByName(compute(missing))


def flag_combinations(cb: DataFrame, listed: DataFrame, k: int, out: str) -> DataFrame:
    """Flags the combinations that are listed, whatever the order of their members."""
    key = F.array_sort(F.array(*ids(k)))
    mark = listed.select(key.alias("_key")).distinct().withColumn(out, F.lit(True))
    return cb.withColumn("_key", key).join(mark, "_key", "left").fillna(False, [out]).drop("_key")


def is_complete_family(combinations: DataFrame, k: int) -> bool:
    """Whether all combinations of the members that occur are there."""
    from ..functions.text import combinations_count

    rows = combinations.select(F.array_sort(F.array(*ids(k))).alias("m")).distinct()
    n = rows.select(F.explode("m").alias("b")).agg(F.count_distinct("b")).first()[0]
    return rows.count() == combinations_count(n, k)


def other_branches(valid: DataFrame, target: DataFrame, sisters: DataFrame | None = None) -> DataFrame:
    """branch_id of valid branches that aren't targets; with ``sisters`` only those among them."""
    out = valid.select("branch_id").distinct().join(target.select("branch_id"), "branch_id", "left_anti")
    return out if sisters is None else out.join(sisters.select("branch_id"), "branch_id", "left_semi")


def taxon_differences(tree: DataFrame, alignment: DataFrame) -> DataFrame:
    """name, only_in ('tree' or 'alignment') of names that the other one lacks."""
    t, a = tree.select("name").distinct(), alignment.select("name").distinct()
    return t.join(a, "name", "left_anti").withColumn("only_in", F.lit("tree")).unionByName(a.join(t, "name", "left_anti").withColumn("only_in", F.lit("alignment")))


def same_topology(x: DataFrame, y: DataFrame) -> bool:
    """Whether two trees (clade, leaf) have the same sets of leaves below their nodes, whatever the nodes are called."""
    sets = [t.groupBy("clade").agg(F.array_join(F.array_sort(F.collect_set("leaf")), "\n").alias("s")).select("s").distinct() for t in (x, y)]
    return not sets[0].exceptAll(sets[1]).limit(1).count() and not sets[1].exceptAll(sets[0]).limit(1).count()


def lineage_path(ancestors: DataFrame, top: int, bottom: int) -> DataFrame:
    """branch_id, depth: branches from below ``top`` down to ``bottom``, from (node, ancestor, depth); none where top is no ancestor."""
    own = ancestors.where(F.col("node") == bottom)
    reach = own.where(F.col("ancestor") == top).select(F.col("depth").alias("_d"))
    up = own.select(F.col("ancestor").alias("branch_id"), "depth").unionByName(own.limit(1).select(F.lit(bottom).cast(own.schema["node"].dataType).alias("branch_id"), F.lit(0).alias("depth")))
    return up.join(F.broadcast(reach)).where(F.col("depth") < F.col("_d")).select("branch_id", (F.col("_d") - F.col("depth")).alias("depth"))
