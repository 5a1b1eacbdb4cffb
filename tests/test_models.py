"""Simulation, gaps, null counts, pseudocounts, tilts and recoding."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.functions import recoding
from cladewise.operators import expected, nulls, simulate
from cladewise.sources import newick

PI = np.array([0.1, 0.2, 0.3, 0.4])
Q = expected.reversible(np.ones((4, 4)), PI)
ROOT = newick.parse("((A:0.5,B:0.5)x:0.3,(C:0.5,D:0.5)y:0.3);")


def test_evolve(spark):
    s = simulate.evolve(spark, ROOT, Q, PI, 4000)
    counts = {r.state: r["count"] for r in s.where("node = 0").groupBy("state").count().collect()}
    assert np.allclose([counts[i] / 4000 for i in range(4)], PI, atol=0.03)
    same = s.where("node in (0, 1)").groupBy("site").agg(F.count_distinct("state").alias("k")).where("k = 1").count() / 4000
    left, values, right = expected.eigen(Q, PI)
    p = left * np.exp(values * 1.0) @ right
    assert abs(same - PI @ np.diag(p)) < 0.03
    again = simulate.evolve(spark, ROOT, Q, PI, 4000).repartition(7)
    assert again.agg(F.sum(F.hash("node", "site", "state"))).first()[0] == s.agg(F.sum(F.hash("node", "site", "state"))).first()[0]


def test_biased_rates():
    m = simulate.biased_rates(Q, PI, [2], 90)
    flow = PI[:, None] * m
    assert np.allclose(flow, flow.T) and np.allclose(m.sum(axis=1), 0) and np.isclose(-(PI @ np.diag(m)), 1)
    np.fill_diagonal(flow, 0)
    assert np.isclose((flow[2].sum() + flow[:, 2].sum()) / flow.sum(), 0.9)


def test_gap_presence(spark):
    rows = [(0, 0, True), (1, 0, True), (2, 0, False), (3, 0, False), (0, 1, True), (1, 1, False), (2, 1, True), (3, 1, True)]
    got = {(r.site, r.node): r.present for r in simulate.gap_presence(spark.createDataFrame(rows, "tip int, site int, present boolean"), ROOT).collect()}
    x, y = (n.branch_id for n in ROOT.children)
    assert got[0, x] and not got[0, y] and got[0, ROOT.branch_id]
    assert got[1, ROOT.branch_id] and got[1, x] and got[1, y] and not got[1, 1]


@pytest.mark.parametrize("dispersion,variance", [(0.0, 5.0), (0.5, 17.5)])
def test_simulated_counts(spark, dispersion, variance):
    df = spark.createDataFrame([(i, 5.0) for i in range(40)], "i int, m double")
    s = nulls.simulated_counts(df, ["i"], "m", 200, dispersion).agg(F.avg("count").alias("m"), F.var_samp("count").alias("v")).first()
    assert abs(s.m - 5) < 0.3 and abs(s.v / variance - 1) < 0.15


def test_parameters(spark):
    rng = np.random.default_rng(6)
    lam = rng.gamma(2.0, 0.5, 800)
    df = spark.createDataFrame([(float(rng.poisson(x * 8)), 8.0) for x in lam], "o double, e double")
    assert 1.4 < nulls.empirical_alpha(df, "o", "e") < 2.9
    # a median of squared deviations lies well below the true 0.5
    moments = [((r.o - 8) ** 2 - 8) / 64 for r in df.collect()]
    assert np.isclose(nulls.dispersion_by_moments(df, "o", "e"), max(np.median(moments), 0)) and nulls.dispersion_by_moments(df.limit(5), "o", "e") == 0
    z = rng.normal(size=60)
    w = np.exp(z) / np.exp(z).sum()
    rows = [(b, i, float(c), 1 / 60, float(z[i])) for b in range(5) for i, c in enumerate(rng.multinomial(500, w))]
    t = spark.createDataFrame(rows, "branch_id int, site int, n double, weight double, z double")
    assert abs(nulls.fit_tilt(t, "z", 5.0) - 1) <= 0.2
    tilted = {r.site: r.weight for r in nulls.tilted_weights(t, "z", 1.0, 9.0).where("branch_id = 0").collect()}
    assert np.allclose([tilted[i] for i in range(60)], w)


def test_recoding(spark):
    p = spark.createDataFrame([("n", 0, "A", 0.5), ("n", 0, "G", 0.25), ("n", 0, "W", 0.25)], "node string, site int, state string, p double")
    assert {r.state: r.p for r in recoding.recode(p, "Dayhoff-6").collect()} == {"AGPST": 0.75, "FWY": 0.25}
    assert all(sorted("".join(g)) == sorted("ACDEFGHIKLMNPQRSTVWY") for g in recoding.SCHEMES.values())
    with pytest.raises(ValueError):
        recoding.classes("x")
