"""Event tables, projections and combination counts against dense NumPy tensors."""

from decimal import Decimal
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise import queries
from cladewise.functions import numeric
from cladewise.operators import combine, events as ev, expected, rates, ranking


@pytest.fixture(scope="module")
def dense():
    rng = np.random.default_rng(4)
    x = rng.random((6, 9, 2, 3, 3)) * (rng.random((6, 9, 2, 3, 3)) < 0.4)
    for i in range(3):
        x[:, :, :, i, i] = 0
    return x


@pytest.fixture(scope="module")
def table(spark, dense):
    rows = [(*map(int, i), float(dense[tuple(i)])) for i in np.argwhere(dense)]
    return spark.createDataFrame(rows, "branch_id int, site int, grp int, a int, d int, pp double")


AXES = {"any2any": (3, 4), "spe2any": (4,), "any2spe": (3,), "spe2spe": ()}


def test_totals(table, dense):
    assert np.allclose([r.sub for r in ev.branch_totals(table).orderBy("branch_id").collect()], dense.sum((1, 2, 3, 4)))
    assert np.allclose([r["sub"] for r in ev.site_totals(table).orderBy("site").collect()], dense.sum((0, 2, 3, 4)))
    total = {(r.grp, r.a, r.d): r.total for r in ev.group_state_totals(table).collect()}
    assert np.isclose(total[1, 0, None], dense.sum((0, 1))[1, 0].sum()) and np.isclose(total[0, None, 2], dense.sum((0, 1))[0, :, 2].sum())


@pytest.mark.parametrize("k", [2, 3])
def test_counts(spark, table, dense, k):
    c = spark.createDataFrame(list(combinations(range(6), k)), ", ".join(f"{x} int" for x in combine.ids(k)))
    got = {tuple(r[:k]): r for r in combine.counts(table, c, k).collect()}
    assert len(got) == len(list(combinations(range(6), k)))
    for ids, r in got.items():
        for stat, axes in AXES.items():
            p = dense.sum(axis=axes) if axes else dense
            assert np.isclose(np.prod([p[b] for b in ids], axis=0).sum(), r[f"OCN{stat}"], atol=1e-12)


def test_sitewise_changes_of_close_and_unknown_states(spark, tmp_path):
    """Sums are ranked and cut as they are, not by nine digits; unknown states come last. The rows are those of the query's SQL."""
    rows = [(1, 1, 1, 0.6000000001, "A"), (1, 1, 2, 0.6000000002, "N"), (2, 1, 1, 0.4999999996, "A"), (3, 1, 1, 0.5, "R")]
    rows += [(4, 1, 1, 0.75, None), (4, 1, 2, 0.75, "N"), (5, 2, 1, 0.75, None)]
    spark.createDataFrame(rows, "l_partkey long, l_suppkey long, l_linenumber int, l_discount double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 4), (2, 5)], "s_suppkey long, s_nationkey int").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {r.branch_id: r.changes for r in queries.sitewise_changes(spark, str(tmp_path)).collect()}
    assert got == {4: "N22,R41,N52", 5: None}


@pytest.mark.parametrize("values", [[0.1] * 10, [0.1, 0.2, 0.3], [0.3, 0.2, 0.1], [float("nan"), 0.5], [float("inf"), 1.0], [1e300, 1.0], [2.0**-40, 0.5]])
def test_exact_sum(spark, values):
    """The order of values doesn't matter (0.1 + 0.2 + 0.3 is 0.6000000000000001 in doubles, the other way round 0.6)."""
    df = spark.createDataFrame([(v,) for v in values + [None]], "x double").agg(numeric.exact_sum(F.col("x")).alias("s"))
    assert np.array_equal([df.first().s], [float(sum(map(Decimal, map(str, values))))], equal_nan=True)


def test_differences_are_clamped(spark):
    cb = spark.createDataFrame([(1.0, 1.0 + 1e-12, 0.5, 0.25), (1.0, 2.0, 0.0, 0.0)], "OCNany2any double, OCNany2spe double, OCNspe2any double, OCNspe2spe double")
    x, y = combine.add_differences(cb, "OCN").collect()
    assert x.OCNany2dif == 0 and x.OCNspe2dif == 0.25 and np.isnan(y.OCNany2dif)


def tree(spark):
    # 6 = root of 4 = (0, 1) and 5 = (2, 3)
    return spark.createDataFrame([(0, 4), (1, 4), (2, 5), (3, 5), (4, 6), (5, 6), (6, None)], "node int, parent int")


def test_independence_and_expansion(spark):
    dep = combine.dependent_pairs(tree(spark))
    pairs = {tuple(r) for r in dep.collect()}
    assert {(0, 4), (0, 6), (0, 1), (4, 5), (2, 3)} <= pairs and (0, 2) not in pairs and (0, 5) not in pairs
    b = spark.createDataFrame([(i,) for i in range(6)], "branch_id int")
    free = combine.independent(combine.pairs(b), dep, 2)
    assert {tuple(r) for r in free.collect()} == {(0, 2), (0, 3), (1, 2), (1, 3), (0, 5), (1, 5), (2, 4), (3, 4)}
    everything = combine.expand(free, 2)
    brute = {tuple(sorted(set(x) | set(y))) for x in map(tuple, free.collect()) for y in map(tuple, free.collect()) if len(set(x) | set(y)) == 3}
    assert {tuple(r) for r in everything.collect()} == brute
    assert combine.expand(free, 2, dep).count() == 0
    no_root = {tuple(r) for r in combine.dependent_pairs(tree(spark), sisters=False, root_has_states=False).collect()}
    assert (0, 5) in no_root and (0, 2) not in no_root


def test_events_from_posteriors(spark):
    post = spark.createDataFrame([("p", 0, "A", 0.75), ("p", 0, "C", 0.25), ("x", 0, "A", 0.5), ("x", 0, "C", 0.5)], "node string, site int, state string, p double")
    e = ev.substitution_events(post, spark.createDataFrame([("x", "p")], "node string, parent string"), spark.createDataFrame([("A", 0), ("C", 0)], "state string, grp int"))
    assert {(r.a, r.d): r.pp for r in e.collect()} == {("A", "C"): 0.375, ("C", "A"): 0.125}


def test_rates_keep_ieee_rules(spark):
    cb = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (1.0, 0.0, 2.0, 1.0), (1.0, 2.0, 0.0, 3.0)], "OCNx double, ECNx double, OCSx double, ECSx double")
    x, y, z = rates.add_rates(cb, ["x"]).collect()
    assert (x.dNCx, x.omegaCx) == (0, 0) and y.dNCx == float("inf") and y.dSCx == 2 and y.omegaCx == float("inf")
    assert (z.dNCx, z.dSCx) == (0.5, 0) and z.omegaCx == float("inf")


def test_ranks(spark):
    rng = np.random.default_rng(9)
    v = np.round(rng.random(300), 2)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)] + [(900, float("nan")), (901, None)], "i int, x double")
    got = {r.i: r for r in ranking.bh_qvalues(ranking.average_rank(df, "x"), "x").collect()}
    order = np.argsort(v, kind="stable")
    q = np.empty(300)
    q[order] = np.minimum(1, np.minimum.accumulate((v[order] * 300 / np.arange(1, 301))[::-1])[::-1])
    for i in range(300):
        assert got[i].avg_rank == (v < v[i]).sum() + ((v == v[i]).sum() + 1) / 2 and np.isclose(got[i].q, q[i])
    assert got[900].avg_rank is None and got[901].q is None


def test_quantile_map(spark):
    rng = np.random.default_rng(1)
    x, y = rng.random(60), rng.random(60) * 0.3
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "i int, x double, y double")
    rank = np.argsort(np.argsort(y)) + 1
    expect = np.maximum(y, np.quantile(x, (rank - 0.5) / 60))
    assert np.allclose([r.z for r in ranking.quantile_map(df, "x", "y", "z").orderBy("i").collect()], expect)


def test_codon_model(spark):
    rng = np.random.default_rng(3)
    s = rng.random((4, 4))
    s, pi = (s + s.T) / 2, np.array([0.1, 0.2, 0.3, 0.4])
    q = expected.reversible(s, pi)
    assert np.isclose(-(pi @ np.diag(q)), 1) and np.allclose(pi @ q, 0)
    left, values, right = expected.eigen(q, pi)
    step = np.linalg.matrix_power(np.eye(4) + q * 0.7 / 2**20, 2**20)
    assert np.allclose(left * np.exp(values * 0.7) @ right, step, atol=1e-5)
    parents = spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0, 0.0], 0.7, 1.0), (2, 0, [1.0, 0.0, 0.0, 0.0], 0.0, 1.0)], "branch_id int, site int, p array<double>, t double, rate double")
    rows = expected.expected_states(parents, q, pi).collect()
    assert len(rows) == 1 and np.allclose(rows[0].p, step[0], atol=1e-5)


@pytest.mark.parametrize("law", [expected.fisher_inclusion, expected.wallenius_inclusion])
def test_inclusion(law):
    w = np.array([0, 1, 2, 3, 4.0])
    p = law(w, 2)
    assert np.isclose(p.sum(), 2) and p[0] == 0 and (np.diff(p) > 0).all() and (law(w, 9)[1:] == 1).all()
    assert np.allclose(expected.fisher_inclusion(np.ones(5), 2), 0.4)


def test_closed_form(spark):
    p = [(1, 0, 0, s, x) for s, x in zip("ABC", (0.2, 0.3, 0.5))]
    c = [(1, 0, 0, s, x) for s, x in zip("ABC", (0.6, 0.4, 0.0))]
    schema = "branch_id int, site int, grp int, state string, p double"
    v = expected.closed_form_projections(spark.createDataFrame(p, schema), spark.createDataFrame(c, schema)).first().v
    assert np.isclose(v, sum(x[4] * y[4] for x in p for y in c if x[3] != y[3]))


def test_permuted_overlap_is_stable(spark):
    w = spark.createDataFrame([(b, s, 0.1) for b in range(3) for s in range(10)], "branch_id int, site int, weight double")
    d = spark.createDataFrame([(b, 4) for b in range(3)], "branch_id int, n int")
    pairs = spark.createDataFrame([(0, 1), (1, 2)], "branch_id_1 int, branch_id_2 int")
    x = expected.permuted_overlaps(w, d, pairs, 200).groupBy("branch_id_1").agg(F.avg("overlap").alias("m"))
    rows = {r[0]: r.m for r in x.collect()}
    assert all(abs(m - 1.6) < 0.25 for m in rows.values())  # 4 * 4 / 10
    again = expected.permuted_overlaps(w.repartition(7), d, pairs, 200).groupBy("branch_id_1").agg(F.avg("overlap").alias("m"))
    assert {r[0]: r.m for r in again.collect()} == rows
