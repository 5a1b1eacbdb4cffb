"""Expected events: codon model and urns.

What a branch needs (a rate matrix's eigen-decomposition, a few dozen states) is
small and broadcast; branches and sites are what Spark spreads.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .events import FEATURES


def reversible(exchange: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Rate matrix of symmetric exchangeabilities and stationary frequencies, scaled to one change per unit time."""
    q = exchange * pi[None, :]
    np.fill_diagonal(q, 0)
    np.fill_diagonal(q, -q.sum(axis=1))
    return q / -(pi @ np.diag(q))


def eigen(q: np.ndarray, pi: np.ndarray):
    """left, values, right with expm(q t) = left * exp(values t) * right, by symmetrising with the root of pi."""
    r = np.sqrt(pi)
    values, vectors = np.linalg.eigh((r[:, None] * q / r[None, :] + (r[:, None] * q / r[None, :]).T) / 2)
    return vectors / r[:, None], values, vectors.T * r[None, :]


def eigen_general(q: np.ndarray):
    """left, values, right as for ``eigen``, of a rate matrix that need not be reversible; they may be complex, and the product's real part counts."""
    values, vectors = np.linalg.eig(q)
    back = np.linalg.inv(vectors)
    if not np.allclose((vectors * values) @ back, q, atol=1e-8 * max(1.0, np.abs(q).max())):
        raise ValueError("the rate matrix has no full set of eigenvectors")
    return vectors, values, back


def expected_states(parents: DataFrame, q: np.ndarray, pi: np.ndarray | None = None) -> DataFrame:
    """branch_id, site, p (array): each parent's state vector after the branch's time at the site's rate (pi of None: a rate matrix that isn't reversible).

    parents: branch_id, site, p (array over states), t, rate. A time below 1e-9
    gives no row, so nothing is expected there.
    """
    shared = parents.sparkSession.sparkContext.broadcast(eigen_general(q) if pi is None else eigen(q, pi))

    def run(batches):
        left, values, right = shared.value
        for pdf in batches:
            if len(pdf):
                p = np.stack(pdf["p"].to_numpy())
                moved = (p @ left) * np.exp((pdf["t"] * pdf["rate"]).to_numpy()[:, None] * values[None, :])
                yield pd.DataFrame({"branch_id": pdf["branch_id"], "site": pdf["site"], "p": list(np.clip((moved @ right).real, 0, None))})

    return parents.where("t >= 1e-9").select("branch_id", "site", "p", "t", "rate").mapInPandas(run, "branch_id int, site int, p array<double>")


def closed_form_projections(parent: DataFrame, child: DataFrame, stats=tuple(FEATURES)) -> DataFrame:
    """branch_id, site, stat, grp, a, d, v of the events p(a) * c(d), a <> d, from state vectors, as events.projections gives them.

    parent and child: branch_id, site, grp, state, p. any2any is sum(p) * sum(c)
    - sum(p * c), spe2any p * (sum(c) - c), any2spe c * (sum(p) - p); only
    spe2spe pairs the states.
    """
    keys = ["branch_id", "site", "grp"]
    state = F.col("state").cast("string").alias("state")
    up, down = parent.select(*keys, state, F.col("p").alias("pp")), child.select(*keys, state, F.col("p").alias("pc"))
    none, own, nothing = F.lit(""), F.col("state"), F.lit(0.0)
    both = up.withColumn("pc", nothing).unionByName(down.withColumn("pp", nothing)).groupBy(*keys, "state").agg(F.sum("pp").alias("pp"), F.sum("pc").alias("pc"))
    w = Window.partitionBy(*keys)
    both = both.withColumns({"sp": F.sum("pp").over(w), "sc": F.sum("pc").over(w), "same": F.sum(F.col("pp") * F.col("pc")).over(w), "first": F.min("state").over(w)})
    form = lambda stat, a, d, v: F.struct(F.lit(stat).alias("stat"), a.alias("a"), d.alias("d"), v.alias("v"))
    forms = {
        "any2any": form("any2any", none, none, F.when(own == F.col("first"), F.col("sp") * F.col("sc") - F.col("same"))),
        "spe2any": form("spe2any", own, none, F.col("pp") * (F.col("sc") - F.col("pc"))),
        "any2spe": form("any2spe", none, own, F.col("pc") * (F.col("sp") - F.col("pp"))),
    }
    wanted = [x for s, x in forms.items() if s in stats]
    rows = [both.select(*keys, F.explode(F.array(*wanted)).alias("x"))] if wanted else []
    if "spe2spe" in stats:
        to = down.withColumnRenamed("state", "to")
        rows.append(up.join(to, keys).where("state <> to").select(*keys, form("spe2spe", own, F.col("to"), F.col("pp") * F.col("pc")).alias("x")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("branch_id", "site", "x.stat", "grp", "x.a", "x.d", "x.v").where("v > 0")


def site_weights(totals: DataFrame, sites: int, alpha: float = 0.0) -> DataFrame:
    """Adds weight = (sub + alpha) / (sum of sub + alpha * sites) per branch to (branch_id, site, sub)."""
    w = Window.partitionBy("branch_id")
    return totals.withColumn("weight", (F.col("sub") + alpha) / F.nullif(F.sum("sub").over(w) + alpha * sites, F.lit(0.0)))


def urn_expectation(weights: DataFrame, branch_totals: DataFrame, pairs: DataFrame) -> DataFrame:
    """branch_id_1, branch_id_2, expected: n1 * n2 * sum over sites of w1 * w2 (draws in proportion to site weights)."""
    x = weights.select(F.col("branch_id").alias("branch_id_1"), "site", F.col("weight").alias("w1"))
    y = weights.select(F.col("branch_id").alias("branch_id_2"), "site", F.col("weight").alias("w2"))
    both = x.join(y, "site").where("branch_id_1 < branch_id_2").join(pairs, ["branch_id_1", "branch_id_2"], "left_semi")
    s = both.groupBy("branch_id_1", "branch_id_2").agg(F.sum(F.col("w1") * F.col("w2")).alias("s"))
    for i in "12":
        t = branch_totals.select(F.col("branch_id").alias(f"branch_id_{i}"), F.col("sub").alias(f"n{i}"))
        s = s.join(F.broadcast(t), f"branch_id_{i}")
    return s.select("branch_id_1", "branch_id_2", (F.col("n1") * F.col("n2") * F.col("s")).alias("expected"))


def fisher_inclusion(weights: np.ndarray, draws: int) -> np.ndarray:
    """Inclusion probabilities of ``draws`` items under Fisher's (conditional Poisson) law, by elementary symmetric sums."""
    w = np.asarray(weights, float)
    out, positive = np.zeros(len(w)), w > 0
    v = w[positive] / max(w.max(initial=0), 1e-300)
    m = len(v)
    if draws <= 0 or not m:
        return out
    if draws >= m:
        out[positive] = 1
        return out
    prefix, suffix = np.zeros((m + 1, draws + 1)), np.zeros((m + 1, draws + 1))
    prefix[0, 0] = suffix[m, 0] = 1
    for i in range(m):
        prefix[i + 1] = prefix[i]
        prefix[i + 1, 1:] += v[i] * prefix[i, :-1]
        j = m - 1 - i
        suffix[j] = suffix[j + 1]
        suffix[j, 1:] += v[j] * suffix[j + 1, :-1]
    rest = np.array([np.dot(prefix[i, :draws], suffix[i + 1, draws - 1 :: -1]) for i in range(m)])
    out[positive] = v * rest / prefix[m, draws]
    return out


def wallenius_inclusion(weights: np.ndarray, draws: int) -> np.ndarray:
    """Inclusion probabilities of sequential draws: exact for one draw and for small urns, as in the reference.

    Else approximate: 1 - exp(-w * x) with x such that they sum to ``draws``.
    """
    w = np.asarray(weights, float)
    out, positive = np.zeros(len(w)), w > 0
    v = w[positive]
    if draws <= 0 or not len(v):
        return out
    if draws >= len(v):
        out[positive] = 1
        return out
    if draws == 1:
        out[positive] = v / v.sum()
        return out
    if len(v) <= 20 and math.comb(len(v), draws) <= 250_000:
        out[positive] = _sequential_inclusion(v, draws)
        return out
    low, high = 0.0, 1.0
    while (1 - np.exp(-v * high)).sum() < draws:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if (1 - np.exp(-v * mid)).sum() < draws else (low, mid)
    out[positive] = 1 - np.exp(-v * high)
    return out


def _sequential_inclusion(v: np.ndarray, draws: int) -> np.ndarray:
    """Exact, by the probability of each set (bit mask) of items drawn so far, one draw at a time."""
    bits = np.arange(len(v))
    masks, probability = np.zeros(1, np.int64), np.ones(1)
    for _ in range(draws):
        free = (masks[:, None] >> bits & 1) == 0
        # summed over the free items: a difference from the total would lose small weights
        step = probability[:, None] * np.where(free, v, 0) / np.where(free, v, 0).sum(axis=1, keepdims=True)
        masks, where = np.unique((masks[:, None] | 1 << bits)[free], return_inverse=True)
        probability = np.bincount(where, step[free], len(masks))
    return probability @ (masks[:, None] >> bits & 1)


def inclusion(weights: DataFrame, draws: DataFrame, law: str = "fisher") -> DataFrame:
    """branch_id, site, weight: inclusion probabilities per branch of an urn with n draws (branch_id, n).

    A fractional n is the mixture of its floor and the next whole number.
    """
    function = {"fisher": fisher_inclusion, "wallenius": wallenius_inclusion}[law]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("site")
        w, n = pdf["weight"].to_numpy(), max(float(pdf["n"].iloc[0]), 0.0)
        p = function(w, int(n))
        if n % 1:
            p = (1 - n % 1) * p + n % 1 * function(w, int(n) + 1)
        return pdf[["branch_id", "site"]].assign(weight=p)

    kinds = ", ".join(f"{c} {weights.schema[c].dataType.simpleString()}" for c in ("branch_id", "site"))
    return weights.join(F.broadcast(draws), "branch_id").groupBy("branch_id").applyInPandas(run, f"{kinds}, weight double")


#: What tells the features of a statistic apart.
FEATURE = ["stat", "grp", "a", "d"]


def urn_projections(weights: DataFrame, draws: DataFrame, law: str = "independent") -> DataFrame:
    """branch_id, site, stat, grp, a, d, v: the probability that a branch's draws of a feature hold a site.

    weights: branch_id, site, weight, with the columns of a feature if they
    differ by it; draws: branch_id, stat, grp, a, d, n. 'independent': n *
    weight; 'fisher' and 'wallenius': the urns' inclusion probabilities. Counted
    like projections of events (combine.counts_of) they give the expected counts.
    """
    on = ["branch_id", *[c for c in FEATURE if c in weights.columns]]
    rows = draws.join(weights, on)
    if law == "independent":
        return rows.select("branch_id", "site", *FEATURE, (F.col("n") * F.col("weight")).alias("v")).where("v > 0")
    function = {"fisher": fisher_inclusion, "wallenius": wallenius_inclusion}[law]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("site")
        w, n = pdf["weight"].to_numpy(), max(float(pdf["n"].iloc[0]), 0.0)
        p = function(w, int(n))
        if n % 1:
            p = (1 - n % 1) * p + n % 1 * function(w, int(n) + 1)
        return pdf[["branch_id", "site", *FEATURE]].assign(v=p)

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in ["branch_id", "site", *FEATURE])
    return rows.select("branch_id", "site", *FEATURE, "n", "weight").groupBy("branch_id", *FEATURE).applyInPandas(run, f"{kinds}, v double").where("v > 0")


def urn_overlap(weights: DataFrame, draws: DataFrame, pairs: DataFrame, law: str = "fisher") -> DataFrame:
    """branch_id_1, branch_id_2, expected: sites that two branches' urns share on average, the sum of products of their inclusion probabilities."""
    p = inclusion(weights, draws, law)
    x = p.select(F.col("branch_id").alias("branch_id_1"), "site", F.col("weight").alias("w1"))
    y = p.select(F.col("branch_id").alias("branch_id_2"), "site", F.col("weight").alias("w2"))
    met = x.join(y, "site").where("branch_id_1 < branch_id_2").join(pairs, ["branch_id_1", "branch_id_2"], "left_semi").groupBy("branch_id_1", "branch_id_2").agg(F.sum(F.col("w1") * F.col("w2")).alias("expected"))
    return pairs.select("branch_id_1", "branch_id_2").join(met, ["branch_id_1", "branch_id_2"], "left").fillna(0.0, ["expected"])


def permuted_overlaps(weights: DataFrame, draws: DataFrame, pairs: DataFrame, rounds: int, seed: int = 1, first: int = 1) -> DataFrame:
    """branch_id_1, branch_id_2, round (``first`` to ``rounds``), overlap: sites that two branches share when each draws its own without replacement.

    Each (branch, round) draws from a stream seeded by the seed, branch and
    round, so the result doesn't depend on partitions. Sampling is by
    exponential keys, in Spark: the n smallest of -ln(u) / w. A fractional n is
    rounded anew each round, up as often as its fraction says; no branch draws
    more than its sites of positive weight.
    """
    uniform = lambda *c: (F.pmod(F.xxhash64(F.lit(seed), *c), F.lit(2**40)) + 0.5) / float(2**40)
    u, up = uniform("branch_id", "site", "round"), uniform("branch_id", "round", F.lit("size"))
    size = F.floor("n") + (up < F.col("n") - F.floor("n")).cast("long")
    drawn = weights.where("weight > 0").withColumn("round", F.explode(F.sequence(F.lit(first), F.lit(rounds)))).withColumn("key", -F.ln(u) / F.col("weight"))
    order = Window.partitionBy("branch_id", "round").orderBy("key", "site")
    drawn = drawn.withColumn("r", F.row_number().over(order)).join(F.broadcast(draws), "branch_id").where(F.col("r") <= size).select("branch_id", "round", "site")
    x, y = drawn.withColumnRenamed("branch_id", "branch_id_1"), drawn.withColumnRenamed("branch_id", "branch_id_2")
    both = x.join(y, ["round", "site"]).join(pairs, ["branch_id_1", "branch_id_2"]).groupBy("branch_id_1", "branch_id_2", "round").agg(F.count(F.lit(1)).alias("overlap"))
    every = pairs.withColumn("round", F.explode(F.sequence(F.lit(first), F.lit(rounds))))
    return every.join(both, ["branch_id_1", "branch_id_2", "round"], "left").fillna(0, ["overlap"])
