"""Preparation of contact tilts: how strongly a branch's substitutions follow the sites like its own.

A site's score on a branch is the branch's context (the mean features of the
sites it changed at) times the site's features. A tilt multiplies the site's
prior by exp(beta * score), clipped. beta, the clip and the prior's pseudocount
are chosen together, by the likelihood of held-out branches, within each group
of branches: a channel, or a channel's bin of root distances. A task holds one
branch's sites and scores the whole grid of parameters on them.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import finite
from ..plans.settled import settled
from .nulls import TILTS
from .ranking import exact_quantiles

#: The grids of the joint choice, and where an automatic clip lies.
ALPHAS = (0.0, 0.5, 1.0, 2.0)
CLIPS = (1.5, 2.0, 2.5, 3.0, 4.0, 5.0)
AUTO_CLIP_SHARE, AUTO_CLIP_LEAST, AUTO_CLIP_MOST = 0.995, 1.5, 5.0
FOLDS, TOL = 5, 1e-12


class Choice(NamedTuple):
    """Parameters of a group; score is the mean log-likelihood over folds, NaN without two active branches."""

    beta: float
    clip: float
    alpha: float
    score: float
    folds: int
    branches: int


def branch_scores(counts: DataFrame, features: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Adds score to counts (keys, branch_id, site, n): context times features (site, feature, value), their mean over features.

    A row is a site that its branch has; the context of a branch without counts is 0.
    """
    keys = [*keys, "branch_id"]
    each = counts.join(features, "site")
    context = each.groupBy(*keys, "feature").agg(F.sum(F.col("n") * F.col("value")).alias("_sum"), F.sum("n").alias("_n"))
    context = context.select(*keys, "feature", F.when(F.col("_n") > TOL, F.col("_sum") / F.col("_n")).otherwise(0.0).alias("_context"))
    score = each.join(context, [*keys, "feature"]).groupBy(*keys, "site").agg(F.avg(F.col("_context") * F.col("value")).alias("score"))
    return counts.join(score, [*keys, "site"])


def depth_groups(counts: DataFrame, depths: DataFrame, bins: int, keys: Sequence[str] = ()) -> DataFrame:
    """Adds depth_bin to counts: branches with counts in at most ``bins`` bins of equal number by root distance (branch_id, depth); others drop out.

    A depth that isn't known counts as the median of the others. The first bins
    are one larger where the number doesn't divide.
    """
    known = depths.where(finite(F.col("depth")))
    middle = exact_quantiles(known, "depth", 0.5).first()
    fill = middle[0] if middle else 0.0
    d = depths.select("branch_id", F.when(finite(F.col("depth")), F.col("depth")).otherwise(fill).alias("depth"))
    active = counts.groupBy(*keys, "branch_id").agg(F.sum("n").alias("_n")).where(F.col("_n") > TOL).join(d, "branch_id")
    w = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    ranked = active.select(*keys, "branch_id", (F.row_number().over(w.orderBy("depth", "branch_id")) - 1).alias("_r"), F.count(F.lit(1)).over(w).alias("_k"))
    used = F.least(F.lit(bins), F.col("_k"))
    small, large = F.floor(F.col("_k") / used), F.col("_k") % used
    bin_ = F.when(F.col("_r") < large * (small + 1), F.floor(F.col("_r") / (small + 1))).otherwise(large + F.floor((F.col("_r") - large * (small + 1)) / small))
    return counts.join(ranked.select(*keys, "branch_id", bin_.cast("int").alias("depth_bin")), [*keys, "branch_id"])


def held_out_rows(counts: DataFrame, groups: Sequence[str], folds: int = FOLDS) -> DataFrame:
    """groups, branch_id, site, n, score, fold, prior, folds, branches of the active branches: the prior is the sites' counts in the group's other folds."""
    total = counts.groupBy(*groups, "branch_id").agg(F.sum("n").alias("_n")).where(F.col("_n") > TOL)
    w = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))  # a tree's branches are few
    dealt = total.select(*groups, "branch_id", (F.row_number().over(w.orderBy("branch_id")) - 1).alias("_r"), F.count(F.lit(1)).over(w).alias("branches"))
    dealt = dealt.where("branches >= 2").withColumn("folds", F.least(F.lit(folds), F.col("branches")).cast("int"))
    dealt = dealt.select(*groups, "branch_id", "branches", "folds", F.pmod("_r", F.col("folds")).alias("fold"))
    rows = counts.select(*groups, "branch_id", "site", "n", "score").join(dealt, [*groups, "branch_id"])
    own = rows.groupBy(*groups, "site", "fold").agg(F.sum("n").alias("_own"))
    prior = own.withColumn("prior", F.greatest(F.sum("_own").over(Window.partitionBy(*groups, "site")) - F.col("_own"), F.lit(0.0))).drop("_own")
    return rows.join(prior, [*groups, "site", "fold"])


def grid_scores(n: np.ndarray, score: np.ndarray, prior: np.ndarray, alphas, clips, betas) -> np.ndarray:
    """Log-likelihood of a branch's counts at its sites by alpha, clip and beta; a beta of 0 or less leaves the prior alone."""
    out = np.empty((len(alphas), len(clips), len(betas)))
    for i, alpha in enumerate(alphas):
        weight = prior + max(alpha, 0.0)
        base = weight / weight.sum() if weight.sum() > TOL else np.full(len(n), 1 / len(n))
        plain = (n * np.log(np.clip(base, TOL, 1))).sum()
        for j, clip in enumerate(clips):
            for k, beta in enumerate(betas):
                out[i, j, k] = plain
                if beta > TOL:
                    p = base * np.exp(np.clip(beta * score, -abs(clip), abs(clip)))
                    if p.sum() > TOL:
                        out[i, j, k] = (n * np.log(np.clip(p / p.sum(), TOL, 1))).sum()
    return out


def choose(counts: DataFrame, groups: Sequence[str] = (), alphas=ALPHAS, clips=CLIPS, betas=TILTS, folds: int = FOLDS, clips_of: dict[tuple, float] | None = None) -> dict[tuple, Choice]:
    """The parameters of each group (its values, as a tuple) of the best mean likelihood over folds.

    counts: groups, branch_id, site, n, score; a row is a site that its branch
    has. Ties go to the earlier alpha, then clip, then the smaller beta; betas of
    0 or less are one, 0. A group with fewer than two branches with counts gets
    a beta of 0 (of the only one there is, if betas lack 0) and the first alpha
    and clip. ``clips_of``: a clip for each group in place of the grid.
    """
    groups, names = list(groups), ["_alpha", "_clip", "_beta"]
    grid = sorted({max(float(b), 0.0) for b in betas})
    schema = ", ".join([*[f"{g} {counts.schema[g].dataType.simpleString()}" for g in groups], "fold int, folds int, branches long, _alpha int, _clip int, _beta int, ll double"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("site")
        head = pdf.iloc[0]
        own = (clips_of[tuple(head[g] for g in groups)],) if clips_of else clips
        ll = grid_scores(*(pdf[c].to_numpy(float) for c in ("n", "score", "prior")), alphas, own, grid)
        at = np.indices(ll.shape).reshape(3, -1)
        return pd.DataFrame({**{g: head[g] for g in groups}, "fold": int(head.fold), "folds": int(head.folds), "branches": int(head.branches), "_alpha": at[0], "_clip": at[1], "_beta": at[2], "ll": ll.ravel()})

    each = held_out_rows(counts, groups, folds).groupBy(*groups, "branch_id").applyInPandas(run, schema)
    mean = each.groupBy(*groups, *names, "folds", "branches").agg(F.round(F.sum("ll") / F.first("folds"), 9).alias("mean"))
    best = mean.groupBy(*groups).agg(F.min(F.struct((-F.col("mean")).alias("m"), *names, "folds", "branches")).alias("b"))
    chosen = {tuple(r[:-1]): r.b for r in best.collect()}  # a row a group
    out = {}
    for key in (tuple(r) for r in (counts.select(*groups).distinct().collect() if groups else [()])):
        b = chosen.get(key)
        alone = 0.0 if any(abs(x) < 1e-8 for x in betas) else float(betas[0])
        clip = clips_of[key] if clips_of else float(clips[b._clip if b else 0])
        out[key] = Choice(grid[b._beta], clip, float(alphas[b._alpha]), -b.m, b.folds, b.branches) if b else Choice(alone, clip, float(alphas[0]), float("nan"), 0, 0)
    return out


def automatic_clips(counts: DataFrame, groups: Sequence[str], choices: dict[tuple, Choice]) -> dict[tuple, float]:
    """Where each group's |beta * score| is clipped: its quantile over all rows, within bounds; the lower bound for a beta of 0 or less."""
    rows = counts.where(finite(F.col("score"))).withColumn("_abs", F.abs("score"))
    q = {tuple(r[:-1]): r[-1] for r in exact_quantiles(rows, "_abs", AUTO_CLIP_SHARE, list(groups)).collect()}
    inside = lambda v: min(max(v, AUTO_CLIP_LEAST), AUTO_CLIP_MOST)
    return {k: inside(c.beta * q[k]) if c.beta > 0 and k in q else AUTO_CLIP_LEAST for k, c in choices.items()}


def prepare(counts: DataFrame, groups: Sequence[str] = (), beta: float | None = None, clip: float | None = 3.0, alpha: float = 1.0, joint: bool = False) -> dict[tuple, Choice]:
    """Parameters of each group; a ``beta`` or ``clip`` of None is chosen by the data, ``joint`` chooses alpha and clip together with it.

    Without ``joint``, an automatic clip follows from a beta fitted under the
    largest clip; beta is then fitted again under it, and the clip follows once more.
    """
    counts = settled(counts)
    betas = TILTS if beta is None else (beta,)
    if joint:
        return choose(counts, groups, betas=betas)
    if beta is not None:
        keys = [tuple(r) for r in (counts.select(*groups).distinct().collect() if groups else [()])]
        fixed = {k: Choice(float(beta), AUTO_CLIP_MOST if clip is None else clip, alpha, float("nan"), 0, 0) for k in keys}
        return fixed if clip is not None else _clipped(fixed, automatic_clips(counts, groups, fixed))
    first = choose(counts, groups, (alpha,), (AUTO_CLIP_MOST if clip is None else clip,))
    if clip is not None:
        return first
    again = choose(counts, groups, (alpha,), clips_of=automatic_clips(counts, groups, first))
    return _clipped(again, automatic_clips(counts, groups, again))


def _clipped(choices: dict[tuple, Choice], clips: dict[tuple, float]) -> dict[tuple, Choice]:
    return {k: c._replace(clip=clips[k]) for k, c in choices.items()}


def tilts(counts: DataFrame, groups: Sequence[str], choices: dict[tuple, Choice]) -> DataFrame:
    """Adds tilt, exp(clip(beta * score)), by which a site's prior is multiplied; 1 where a group's beta is 0 or less."""
    t = F.lit(1.0)
    for key, c in choices.items():  # a few groups
        own = F.lit(True)
        for g, v in zip(groups, key, strict=True):
            own = own & F.col(g).eqNullSafe(F.lit(v))
        if c.beta > TOL:
            t = F.when(own, F.exp(F.greatest(F.least(F.lit(c.beta) * F.col("score"), F.lit(abs(c.clip))), F.lit(-abs(c.clip))))).otherwise(t)
    return counts.withColumn("tilt", t)
