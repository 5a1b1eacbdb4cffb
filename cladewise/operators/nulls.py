"""Count models for the null distribution, pseudocounts, and contact-weighted site probabilities."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import DoubleType

from ..functions.numeric import finite
from ..plans.settled import settled
from .expected import urn_expectation


@F.pandas_udf(DoubleType())
def log_gamma(x: pd.Series) -> pd.Series:
    return x.map(math.lgamma)


def simulated_counts(df: DataFrame, keys: list[str], mean: str, rounds: int, dispersion: float = 0.0, seed: int = 1) -> DataFrame:
    """keys, round, count: draws of a Poisson law with each row's mean, or negative binomial with variance mean + dispersion * mean^2.

    Each row's stream is seeded by a hash of (seed, keys), whatever the
    partitions; a batch's draws are one matrix, a row for each of its rows.
    """
    kinds = ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches):
        for pdf in batches:
            means = np.maximum(pdf[mean_name].to_numpy(float), 0.0)
            counts = np.empty((len(pdf), rounds), np.int64)
            for i, (s, m) in enumerate(zip(pdf["_seed"].to_numpy() & (2**63 - 1), means, strict=True)):
                rng = np.random.default_rng(s)
                counts[i] = rng.poisson(rng.gamma(1 / dispersion, m * dispersion, rounds) if dispersion > 0 and m > 0 else m, rounds)
            at = np.repeat(np.arange(len(pdf)), rounds)
            yield pdf[keys].iloc[at].assign(round=np.tile(np.arange(rounds, dtype=np.int32), len(pdf)), count=counts.ravel())

    mean_name = mean

    return df.select(*keys, mean_name, F.xxhash64(F.lit(seed), *keys).alias("_seed")).mapInPandas(run, f"{kinds}, round int, count long")


def poisson_overlaps(weights: DataFrame, totals: DataFrame, pairs: DataFrame, rounds: int, dispersion: float = 0.0, seed: int = 1) -> DataFrame:
    """branch_id_1, branch_id_2, round, count: Poisson (or negative binomial) counts whose mean is the urns' expected overlap under each branch's own site weights."""
    mean = urn_expectation(weights, totals, pairs)
    every = pairs.select("branch_id_1", "branch_id_2").join(mean, ["branch_id_1", "branch_id_2"], "left").fillna(0.0, ["expected"])
    return simulated_counts(every, ["branch_id_1", "branch_id_2"], "expected", rounds, dispersion, seed)


def automatic_clip(scores: DataFrame, score: str, beta: float, share: float = 0.995, least: float = 1.5, most: float = 5.0) -> float:
    """Where |beta * score| is clipped: its quantile ``share`` over sites that are there, between ``least`` and ``most``; least for a beta of 0 or less."""
    if beta <= 0:
        return least
    v = F.abs(F.lit(beta) * F.col(score))
    q = scores.where(finite(F.col(score))).agg(F.percentile(v, share)).first()[0]
    return least if q is None else min(max(q, least), most)


def dispersion_by_moments(df: DataFrame, observed: str, mean: str, least: int = 20, most: float = 10.0) -> float:
    """Median of ((o - m)^2 - m) / m^2 over rows with a positive mean, between 0 and ``most``; 0 for fewer than ``least`` rows."""
    x = (F.pow(F.col(observed) - F.col(mean), 2) - F.col(mean)) / F.pow(F.col(mean), 2)
    n, med = df.where(F.col(mean) > 0).agg(F.count(F.lit(1)), F.percentile(x, 0.5)).first()
    return min(max(med, 0.0), most) if n >= least else 0.0


def empirical_alpha(df: DataFrame, observed: str, expected: str, low: float = 1e-4, high: float = 1e2, points: int = 121, refined: int = 81) -> float:
    """The pseudocount of the best Gamma-Poisson likelihood: observed ~ Poisson(l * expected), l ~ Gamma(alpha, alpha).

    A log grid first, then ``refined`` points between the best one's neighbours.
    All points of a grid are summed in one pass: rows times points, no join.
    """
    a, o, e = F.col("alpha"), F.col(observed), F.greatest(F.col(expected), F.lit(1e-12))
    valid = df.where(finite(F.col(observed)) & finite(F.col(expected)) & (F.col(observed) >= 0) & (F.col(expected) >= 0)).select(observed, expected)
    ll = log_gamma(o + a) - log_gamma(a) + a * F.ln(a) - (o + a) * F.ln(e + a) + o * F.ln(e)

    def best(grid):
        rows = valid.withColumn("alpha", F.explode(F.array(*[F.lit(g) for g in grid])))
        return rows.groupBy("alpha").agg(F.sum(ll).alias("ll")).orderBy(F.desc("ll"), "alpha").first()

    grid = np.geomspace(low, high, points).tolist()
    first = best(grid)
    if not first or points < 3:
        return float(first.alpha) if first else 0.0
    i = int(np.argmin(np.abs(np.array(grid) - first.alpha)))
    second = best(np.geomspace(grid[max(i - 1, 0)], grid[min(i + 1, points - 1)], refined).tolist())
    return float(second.alpha if second.ll >= first.ll else first.alpha)


def tilted_weights(weights: DataFrame, score: str, beta: float, clip: float) -> DataFrame:
    """(branch_id, site, weight) times exp(clip(beta * score)), renormalised within each branch."""
    t = F.greatest(F.least(F.lit(beta) * F.col(score), F.lit(clip)), F.lit(-clip))
    w = weights.withColumn("_t", F.col("weight") * F.exp(t))
    return w.withColumn("weight", F.col("_t") / F.nullif(F.sum("_t").over(Window.partitionBy("branch_id")), F.lit(0.0))).drop("_t")


#: The reference's tilts.
TILTS = (-3.0, -2.5, *(x / 100 for x in range(-200, 201)), 2.5, 3.0)


def best_tilt(p: DataFrame) -> float:
    """The beta of the largest sum of n * ln(p); ties go to the beta nearest 0."""
    best = p.groupBy("beta").agg(F.sum(F.col("n") * F.ln("p")).alias("ll")).orderBy(F.desc(F.round("ll", 9)), F.abs("beta")).first()
    return float(best.beta) if best else 0.0


def fit_tilt(counts: DataFrame, score: str, clip: float, folds: int = 5, grid=TILTS) -> float:
    """The tilt of the best likelihood under given weights: counts (branch_id, site, n, weight), sites dealt to folds by their number.

    Nothing is trained here, so the weights must come from elsewhere: under
    weights of the same events 0 is the trivial best. For those use held_out_tilt.
    """
    rows = counts.withColumn("beta", F.explode(F.array(*[F.lit(float(b)) for b in grid]))).withColumn("fold", F.pmod("site", F.lit(folds)))
    t = F.greatest(F.least(F.col("beta") * F.col(score), F.lit(clip)), F.lit(-clip))
    w = Window.partitionBy("branch_id", "fold", "beta")
    return best_tilt(rows.withColumn("_t", F.col("weight") * F.exp(t)).withColumn("p", F.col("_t") / F.nullif(F.sum("_t").over(w), F.lit(0.0))).where("n > 0 and p > 0"))


def held_out_priors(counts: DataFrame, folds: int = 5, alpha: float = 1.0, tol: float = 1e-12) -> DataFrame:
    """branch_id, site, fold, weight, and the columns of counts (branch_id, site, n): each active branch's weights from the branches of the other folds.

    Branches with counts are dealt to at most ``folds`` folds in the order of
    their ids. A fold's prior is the sites' total counts less the fold's own,
    plus alpha, over the sites that a branch has; even where that is nothing.
    """
    total = counts.groupBy("branch_id").agg(F.sum("n").alias("m")).where(F.col("m") > tol).select("branch_id")
    dealt = total.withColumn("_i", F.row_number().over(Window.orderBy("branch_id")) - 1)  # a tree's branches are few
    k = dealt.count()
    # with fewer than two there is nothing to hold out, and no rows
    dealt = dealt.select("branch_id", F.pmod("_i", F.lit(max(min(folds, k), 1))).alias("fold")).where(F.lit(k >= 2))
    rows = counts.join(F.broadcast(dealt), "branch_id")
    own = rows.groupBy("fold", "site").agg(F.sum("n").alias("_own"))
    prior = own.withColumn("_prior", F.greatest(F.sum("_own").over(Window.partitionBy("site")) - F.col("_own"), F.lit(0.0)) + alpha).drop("_own")
    w = Window.partitionBy("branch_id")
    rows = rows.join(prior, ["fold", "site"]).withColumns({"_s": F.sum("_prior").over(w), "_k": F.count(F.lit(1)).over(w)})
    return rows.withColumn("weight", F.when(F.col("_s") > tol, F.col("_prior") / F.col("_s")).otherwise(1 / F.col("_k"))).drop("_prior", "_s", "_k")


def held_out_tilt(counts: DataFrame, score: str, clip: float, folds: int = 5, alpha: float = 1.0, grid=TILTS, tol: float = 1e-12) -> float:
    """The tilt of the best likelihood of branches under priors of the other folds' branches: counts (branch_id, site, n, score).

    A row is a site that its branch has, also where n is 0. As in the reference,
    a beta of 0 or less leaves the prior alone; such betas score as 0 and come out as 0.
    """
    betas = sorted({max(float(b), 0.0) for b in grid})
    rows = settled(held_out_priors(counts.select("branch_id", "site", "n", score), folds, alpha, tol)).withColumn("beta", F.explode(F.array(*[F.lit(b) for b in betas])))
    t = F.greatest(F.least(F.col("beta") * F.col(score), F.lit(clip)), F.lit(-clip))
    tilted = rows.withColumn("_t", F.col("weight") * F.exp(t)).withColumn("_z", F.sum("_t").over(Window.partitionBy("branch_id", "beta")))
    p = F.when(F.col("_z") > tol, F.col("_t") / F.col("_z")).otherwise(F.col("weight"))
    return best_tilt(tilted.where("n > 0").withColumn("p", F.least(F.greatest(p, F.lit(tol)), F.lit(1.0))))
