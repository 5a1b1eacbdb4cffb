"""Calibration of rates, whole scans of many foregrounds, and what shows their rows."""

import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.functions import sequence
from cladewise.operators import full_scan, gamma, permute, ranking, rates, scan, site_tables, sites

INF, NAN = float("inf"), float("nan")


def test_quantile_map_leaves_odd_rows_alone(spark):
    rows = [(0, 1.0, 5.0), (1, 2.0, 0.5), (2, 3.0, 0.6), (3, INF, 0.7), (4, 4.0, INF), (5, 2.5, NAN), (6, NAN, 0.9), (7, 10.0, 0.6), (8, None, 1.0)]
    got = {r.i: r.z for r in ranking.quantile_map(spark.createDataFrame(rows, "i int, x double, y double"), "x", "y", "z").collect()}
    fit = [r for r in rows if r[1] is not None and math.isfinite(r[1]) and math.isfinite(r[2])]
    y = [r[2] for r in fit]
    rank = [sum(v < w for v in y) + (sum(v == w for v in y) + 1) / 2 for w in y]
    want = {r[0]: max(r[2], v) for r, v in zip(fit, np.quantile([r[1] for r in fit], (np.array(rank) - 0.5) / len(fit)))}
    assert all(abs(got[i] - v) < 1e-12 for i, v in want.items())
    assert got[3] == 0.7 and got[4] == INF and math.isnan(got[5]) and got[6] == 0.9 and got[8] == 1.0 and len(got) == 9


def test_quantile_map_by_group(spark):
    rng = np.random.default_rng(1)
    rows = [(g, i, float(x), float(y)) for g in range(3) for i, (x, y) in enumerate(zip(rng.gamma(2, 1, 30) * (g + 1), rng.normal(size=30).round(1)))]
    got = {(r.g, r.i): r.z for r in ranking.quantile_map(spark.createDataFrame(rows, "g int, i int, x double, y double"), "x", "y", "z", ["g"]).collect()}
    for g in range(3):
        own = [r for r in rows if r[0] == g]
        alone = ranking.quantile_map(spark.createDataFrame(own, "g int, i int, x double, y double"), "x", "y", "z").collect()
        assert all(abs(got[g, r.i] - r.z) < 1e-12 for r in alone)


def plain_gamma(x):
    """The likeliest location among many, by golden sections on the profile likelihood."""
    x = np.array(x)

    def ll(t):
        v = x - (x.min() - x.std() * math.exp(t))
        return gamma._likelihood(v.mean(), np.log(v).mean())[0]

    grid = np.linspace(gamma.NEAR, gamma.FAR, 400)
    values = [ll(t) for t in grid]
    tops = [i for i in range(1, 399) if values[i] >= values[i - 1] and values[i] >= values[i + 1]]
    i = max(tops, key=lambda k: values[k])
    low, high, r = grid[i - 1], grid[i + 1], (math.sqrt(5) - 1) / 2
    for _ in range(100):
        a, b = high - r * (high - low), low + r * (high - low)
        low, high = (low, b) if ll(a) > ll(b) else (a, high)
    return x.min() - x.std() * math.exp((low + high) / 2), ll((low + high) / 2)


def test_gamma_fit_against_a_plain_one(spark):
    rng = np.random.default_rng(7)
    x = (1.5 + rng.gamma(3.0, 0.7, 400)).tolist()
    df = spark.createDataFrame([(v,) for v in x + [INF, NAN]], "x double")
    law = gamma.fit_gamma(df, "x")
    loc, ll = plain_gamma(x)
    v = np.array(x) - law.loc
    own = -math.lgamma(law.shape) - law.shape * math.log(law.scale) + (law.shape - 1) * np.log(v).mean() - v.mean() / law.scale
    assert abs(own - ll) < 1e-9 and abs(law.loc - loc) < 1e-4 and abs(law.shape * law.scale + law.loc - np.mean(x)) < 1e-9
    assert gamma.fit_gamma(spark.createDataFrame([(2.0,)] * 3, "x double"), "x") is None
    assert np.allclose(gamma.quantiles(gamma.Gamma(1, 2, 3), np.array([0.1, 0.9])), 2 - 3 * np.log1p(-np.array([0.1, 0.9])))
    z = NormalDist().inv_cdf(0.975)
    assert np.allclose(gamma.quantiles(gamma.Gamma(0.5, 0, 2), np.array([0.95])), z * z)  # chi-squared with one degree of freedom


def test_gamma_calibration(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(rng.gamma(2, 2, 60), rng.gamma(2, 0.2, 60)))] + [(60, 1.0, INF), (61, NAN, 0.4)]
    df = spark.createDataFrame(rows, "i int, dNCx double, dSCx double").withColumn("omegaCx", F.col("dNCx") / F.col("dSCx"))
    got = {r.i: r for r in rates.calibrate(df, ["x"], "gamma").collect()}
    law = gamma.fit_gamma(df.where("i < 60"), "dNCx")
    y = np.array([r[2] for r in rows[:60]])
    want = np.maximum(y, gamma.quantiles(law, (y.argsort().argsort() + 0.5) / 60))
    assert all(abs(got[i].dSCx - want[i]) < 1e-9 and abs(got[i].omegaCx - rows[i][1] / want[i]) < 1e-9 for i in range(60))
    assert got[60].dSCx == INF and got[61].dSCx == 0.4 and got[0].dSCx_nocalib == rows[0][2]


def test_full_scan_by_hand(spark):
    e = [(1, 0, "A", "G", 0.9), (2, 0, "C", "G", 0.8), (3, 0, "A", "T", 0.9), (4, 0, "C", "G", 0.6), (1, 1, "A", "G", 0.9)]
    events = spark.createDataFrame(e, "branch_id int, site int, a string, d string, pp double")
    units = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (1, 1, 1), (1, 2, 3), (2, 5, 4), (2, 6, 9)], "round long, unit int, branch_id int")
    lengths = spark.createDataFrame([(b, 1.0) for b in (1, 2, 3, 4)], "branch_id int, exposure double")
    got = {(r["round"], r.match, r.key_a, r.key_d): r for r in full_scan.full_scan(events, units, lengths, min_pp=0.5, support="1.0").collect()}
    assert set(got) == {(0, "any2spe", "any", "G"), (0, "any2any", "any", "any"), (0, "dif2spe", "A,C", "G"), (0, "dif2any", "A,C", "any"), (1, "spe2any", "A", "any"), (1, "any2any", "any", "any"), (1, "spe2dif", "A", "G,T"), (1, "any2dif", "any", "G,T")}
    r = got[1, "any2dif", "any", "G,T"]
    assert abs(r.xt - 1.8) < 1e-12 and abs(r.xo - 1.4) < 1e-12 and (r.lt, r.lo, r.units) == (2.0, 2.0, 2)
    assert abs(r.lrt - 2 * (1.8 * math.log(1.8 / 1.6) + 1.4 * math.log(1.4 / 1.6))) < 1e-12
    sisters = spark.createDataFrame([(0, 3), (0, 1)], "round long, branch_id int")
    s = {(r["round"], r.match): r for r in full_scan.full_scan(events, units, lengths, min_pp=0.5, support="2", others=sisters).collect()}
    assert (s[0, "any2any"].lo, s[1, "any2any"].lo) == (1.0, 0.0) and abs(s[0, "any2any"].xo - 0.9) < 1e-12 and s[1, "any2any"].lrt is None
    out = {(r.match, r.key_a): (r.empirical, r.empirical_max) for r in full_scan.calibrated_scan(full_scan.full_scan(events, units, lengths, min_pp=0.5, support="1.0"), 3).collect()}
    assert out["any2any", "any"][0] == 0.5 and out["dif2spe", "A,C"] == (0.25, 0.5)


def test_fixed_candidates_count_rounds_without_mass(spark):
    mass = spark.createDataFrame([(0, "any2any", "any", "any", 1, 2.0), (1, "any2any", "any", "any", 2, 1.0)], "site int, match string, key_a string, key_d string, branch_id int, m double")
    lengths = spark.createDataFrame([(b, 1.0) for b in (1, 2, 3)], "branch_id int, exposure double")
    rounds = spark.createDataFrame([(1, 1), (2, 3), (3, 3)], "round long, branch_id int")
    observed = permute.observed_enrichment(mass, spark.createDataFrame([(1,)], "branch_id int"), lengths)
    got = {r.site: (r.empirical, r.empirical_max) for r in permute.calibrated(observed, permute.permuted_enrichment(mass, rounds, lengths), 3).collect()}
    assert got == {0: (0.5, 0.5), 1: (1.0, 1.0)}  # a statistic of 0 is reached in every round


def test_support_thresholds_agree(spark):
    for value in ("0.3", "1.0", "2", "1"):
        got = [r.n for r in spark.range(1, 12).select(full_scan.least_units(value, F.col("id")).alias("n")).collect()]
        assert got == [scan.support_threshold(value, n) for n in range(1, 12)]


def test_balanced_top(spark):
    rows = [("c", i, float(i), 0.0) for i in range(5)] + [("d", 10 + i, 0.0, 10.0 + i) for i in range(3)] + [("", 20, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "k string, site int, x double, y double")
    top = lambda df, n: sorted(r.site for r in ranking.balanced_top(df, "k", ("c", "d"), ("x", "y"), F.asc("site"), n).collect())
    assert top(df, 3) == [4, 11, 12] and top(df, 7) == [1, 2, 3, 4, 10, 11, 12] and top(df, 1) == [12] and top(df, 20) == [0, 1, 2, 3, 4, 10, 11, 12]
    assert top(df.where("k = 'd'"), 2) == [11, 12] and top(df.where("k = ''"), 2) == [20]


def test_conservation_identity_classes_and_weights(spark):
    s = spark.createDataFrame([(0, "t1", "A", 1.0), (0, "t2", "C", 1.0), (0, "t3", "A", 0.0), (1, "t1", "A", 0.0)], "site int, tip string, state string, p double")
    got = {r.site: r for r in scan.conservation(s, 20).collect()}
    assert (got[0].major, got[0].share, got[0].valid_tips) == ("A", 0.5, 2) and abs(got[0].entropy - math.log(2) / math.log(20)) < 1e-12
    assert got[1].major == "" and math.isnan(got[1].entropy) and got[1].valid_tips == 0
    x = spark.createDataFrame([("A.C-T", "AGC-A"), ("..", "AC")], "x string, y string").select(sequence.identity(F.col("x"), F.col("y")).alias("i")).collect()
    assert abs(x[0].i - 2 / 3) < 1e-12 and x[1].i is None
    for bad in (("A", "AC"), ("", "")):
        with pytest.raises(Exception, match="sequences must"):
            spark.createDataFrame([bad], "x string, y string").select(sequence.identity(F.col("x"), F.col("y"))).collect()
    c = sites.classify(spark.createDataFrame([(NAN, 0.6), (NAN, NAN), (0.7, None)], "x double, y double"), "x", "y", 0.5)
    assert [r.category for r in c.collect()] == ["divergent", "blank", "convergent"]
    e = spark.createDataFrame([(1, 0, "A", "C", 0.0), (2, 0, "A", "G", 0.0)], "branch_id int, site int, a string, d string, pp double")
    v = spark.createDataFrame([(0, "A", "C", -1.0), (0, "A", "G", -3.0)], "site int, a string, d string, score double")
    assert site_tables.variant_scores(e, v, "pp_weighted_mean").first().score == -2.0
