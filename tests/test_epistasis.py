"""Contact tilts: the joint choice of parameters against a NumPy loop."""

import math

import numpy as np
import pytest

from cladewise.operators import epistasis as E, ranking
from cladewise.operators.nulls import TILTS

BETAS = (-1.0, 0.0, 0.25, 0.5, 1.0, 2.0)


def toy(seed=3, branches=7, sites=15):
    rng = np.random.default_rng(seed)
    z = rng.normal(size=(sites, 2))
    have = rng.random((branches, sites)) < 0.9
    lean = rng.normal(size=(branches, 2))
    n = np.where(have, rng.poisson(np.exp(0.8 * lean @ z.T)), 0).astype(float)
    n[2] = 0
    return z, have, n


def plain_scores(z, have, n):
    context = np.array([(n[b, have[b], None] * z[have[b]]).sum(0) / n[b].sum() if n[b].sum() > 0 else np.zeros(z.shape[1]) for b in range(len(n))])
    return context @ z.T / z.shape[1]


def plain_choice(n, have, score, alphas, clips, betas):
    active = np.flatnonzero(n.sum(1) > 0)
    if len(active) < 2:
        return None
    k = min(5, len(active))
    fold, best = np.arange(len(active)) % k, None
    for a in alphas:
        for c in clips:
            for beta in sorted({max(b, 0.0) for b in betas}):
                means = []
                for f in range(k):
                    prior, ll = n[active[fold != f]].sum(0) + a, 0.0
                    for b in active[fold == f]:
                        p = np.where(have[b], prior, 0)
                        p = p / p.sum() if p.sum() > 1e-12 else have[b] / have[b].sum()
                        if beta > 0:
                            w = np.where(have[b], p * np.exp(np.clip(beta * score[b], -c, c)), 0)
                            p = w / w.sum()
                        ll += (n[b] * np.log(np.clip(p, 1e-12, 1))).sum()
                    means.append(ll)
                m = round(float(np.mean(means)), 9)
                if best is None or m > best[0]:
                    best = (m, beta, c, a)
    return best


def frame(spark, z, have, n, channel="N"):
    rows = [(channel, b, s, float(n[b, s])) for b in range(len(n)) for s in range(len(z)) if have[b, s]]
    features = spark.createDataFrame([(s, f, float(z[s, f])) for s in range(len(z)) for f in range(z.shape[1])], "site int, feature int, value double")
    return spark.createDataFrame(rows, "channel string, branch_id int, site int, n double"), features


def test_scores_and_joint_choice(spark):
    z, have, n = toy()
    other = n[::-1].copy()
    counts, features = frame(spark, z, have, n)
    counts = counts.unionByName(frame(spark, z, have[::-1], other, "S")[0])
    scored = E.branch_scores(counts, features, ["channel"])
    want = {"N": plain_scores(z, have, n), "S": plain_scores(z, have[::-1], other)}
    assert all(abs(r.score - want[r.channel][r.branch_id, r.site]) < 1e-12 for r in scored.collect())
    got = E.choose(scored, ["channel"], betas=BETAS)
    for c, (m, h) in {"N": (n, have), "S": (other, have[::-1])}.items():
        score, beta, clip, alpha = plain_choice(m, h, want[c], E.ALPHAS, E.CLIPS, BETAS)
        g = got[(c,)]
        assert (g.beta, g.clip, g.alpha, g.folds, g.branches) == (beta, clip, alpha, 5, 6) and abs(g.score - score) < 1e-8


def test_automatic_clip_and_fixed_values(spark):
    z, have, n = toy(11)
    counts, features = frame(spark, z, have, n)
    scored = E.branch_scores(counts, features, ["channel"]).drop("channel").cache()
    score = plain_scores(z, have, n)
    clip_of = lambda beta: min(max(np.quantile(np.abs(beta * score[have]), 0.995), 1.5), 5.0) if beta > 0 else 1.5
    first = plain_choice(n, have, score, (1.0,), (5.0,), TILTS)[1]
    second = plain_choice(n, have, score, (1.0,), (clip_of(first),), TILTS)[1]
    got = E.prepare(scored, clip=None)[()]
    assert got.beta == second and got.clip == pytest.approx(clip_of(second))
    assert E.prepare(scored, beta=0.7, clip=2.0)[()][:3] == (0.7, 2.0, 1.0)
    assert E.prepare(scored, beta=0.7, clip=None)[()].clip == pytest.approx(clip_of(0.7))
    t = {(r.branch_id, r.site): r.tilt for r in E.tilts(scored, [], {(): E.Choice(0.7, 0.3, 1.0, 0, 0, 0)}).collect()}
    assert all(abs(v - math.exp(np.clip(0.7 * score[k], -0.3, 0.3))) < 1e-12 for k, v in t.items())
    assert {r.tilt for r in E.tilts(scored, [], {(): E.Choice(-1.0, 0.3, 1.0, 0, 0, 0)}).collect()} == {1.0}


def test_depth_bins(spark):
    z, have, n = toy()
    counts, features = frame(spark, z, have, n)
    depths = spark.createDataFrame([(0, 3.0), (1, 1.0), (2, 9.0), (3, float("nan")), (4, 2.0), (5, 8.0), (6, 2.0)], "branch_id int, depth double")
    binned = E.depth_groups(E.branch_scores(counts, features), depths, 4)
    got = {r.branch_id: r.depth_bin for r in binned.select("branch_id", "depth_bin").distinct().collect()}
    assert got == {1: 0, 4: 0, 6: 1, 3: 1, 0: 2, 5: 3}  # branch 2 has no counts; 3 has the median of the known ones, 2.5, and so comes before 0
    choices = E.choose(binned, ["depth_bin"], betas=(0.0, 1.0))
    assert choices[(2,)].folds == 0 and choices[(0,)].folds == 2


def test_exact_quantiles(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g in range(3) for v in rng.integers(0, 30, 101 + g)] + [(0, float("nan")), (9, None)]
    df = spark.createDataFrame(rows, "g int, v double")
    for q in (0.0, 0.5, 0.995, 1.0):
        got = {r.g: r["quantile"] for r in ranking.exact_quantiles(df, "v", q, ["g"]).collect()}
        assert got == pytest.approx({g: np.quantile([v for k, v in rows if k == g and v == v], q) for g in range(3)})
    assert ranking.exact_quantiles(df.where("g = 9"), "v", 0.5).count() == 0
