"""Site jobs, columns of set expressions, urn expectations of all features, and small tables."""

import math
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.functions import sequence
from cladewise.operators import combine, expected, nulls, omega_null, permute, rates, site_jobs as J, summaries, traits

#: Root 9 over 7 (over 1, 2) and 8 (over 3, 4 over 5, 6).
PARENT = {1: 7, 2: 7, 5: 4, 6: 4, 3: 8, 4: 8, 7: 9, 8: 9, 9: None}


@pytest.fixture(scope="module")
def tree(spark):
    up = []
    for n in PARENT:
        a, depth, length = n, 0, 0.0
        while a is not None:
            up.append((n, a, depth, length))
            length += a / 10
            a, depth = PARENT[a], depth + 1
    nodes = spark.createDataFrame(list(PARENT.items()), "node int, parent int")
    return nodes, spark.createDataFrame(up, "node int, ancestor int, depth int, length double")


def test_jobs(spark, tree):
    nodes, up = tree
    jobs = lambda mode, branches="", cb=None: [(r.branch_ids, r.single) for r in J.site_jobs(J.parse_mode(mode), nodes, branches, cb, up.where("depth > 0")).orderBy("branch_ids").collect()]
    assert jobs("intersection", "5, 1") == [([1, 5], False)] and jobs("intersection", "3") == [([3], True)]
    assert jobs("lineage", "8,5") == [([4, 5], False)] and jobs("lineage", "9,1") == [([1, 7], False)]
    assert jobs("set,any,(1|5)-A") == [([1, 5], False)] and jobs("set, spe ,9|3") == [([3], True)]
    cb = spark.createDataFrame([(1, 5, "Y", "N"), (5, 1, "N", "n"), (2, 6, "N", "true"), (3, 3, "1", None), (1, 6, None, None)], "branch_id_1 int, branch_id_2 int, is_fg_a string, is_fg_b string")
    assert jobs("intersection", "fg", cb) == [([1, 5], False), ([2, 6], False), ([3], True)]
    for mode, branches, table in [("intersection", "1,1", None), ("intersection", "1,x", None), ("intersection", "", None), ("intersection", "9", None), ("intersection", "77", None), ("lineage", "8", None), ("lineage", "1,9", None), ("lineage", "1,5", None), ("set,any,9", "", None), ("set,any,77", "", None), ("intersection", "fg", cb.where("branch_id_1 = 1 and branch_id_2 = 6")), ("intersection", "fg", cb.withColumn("branch_id_1", F.lit(50)))]:
        with pytest.raises(ValueError):
            jobs(mode, branches, table)
    for bad in ("set", "set,any", "set,odd,1", "set,any,", "set,any,1|", "other"):
        with pytest.raises(ValueError):
            J.parse_mode(bad)


@pytest.mark.parametrize("text", ["set,any,1|5", "set,spe,1&5", "set,spe,(1|5)-A", "set,any,A-1", "set,spe,1^2"])
def test_set_columns_against_dense_arrays(spark, text):
    rng = np.random.default_rng(6)
    states, branches, n = "ACG", [1, 2, 3, 5], 8
    T = np.where(rng.random((10, n, 3, 3)) < 0.3, rng.random((10, n, 3, 3)), 0)
    T[[0, 4, 6, 7, 8, 9]] = 0
    T[:, :, range(3), range(3)] = 0
    T[:, 7] = 0
    rows = [(b, s, states[a], states[d], float(T[b, s, a, d])) for b, s, a, d in product(branches, range(n), range(3), range(3)) if T[b, s, a, d]]
    events = spark.createDataFrame(rows, "branch_id int, site int, a string, d string, pp double")
    mode = J.parse_mode(text)
    got = {r.site: r for r in J.set_columns(spark.range(n).selectExpr("cast(id as int) as site"), events, mode, 0.6, events).collect()}
    v = T.sum(2) if mode.stat == "spe" else T.sum((2, 3))[:, :, None]
    named = sorted(int(x) for x in text.split(",")[2] if x.isdigit())
    A = v[[b for b in branches if b not in named]].max(0)
    on, p = {**{b: v[b] >= 0.6 for b in named}, "A": A >= 0.6}, {**{b: v[b] for b in named}, "A": A}
    p = {k: np.where(on[k], p[k], 0) for k in p}
    if text.endswith("1|5"):
        member, prob = on[1] | on[5], np.maximum(p[1], p[5])
    elif text.endswith("1&5"):
        member, prob = on[1] & on[5], np.minimum(p[1], p[5])
    elif text.endswith("A-1"):
        member, prob = on["A"] & ~on[1], p["A"]
    elif text.endswith("1^2"):
        member, prob = on[1] != on[2], np.maximum(p[1], p[2])
    else:
        member, prob = (on[1] | on[5]) & ~on["A"], np.maximum(p[1], p[5])
    prob = np.where(member, prob, 0)
    for s in range(n):
        r = got[s]
        assert r.N_set_expr == bool(member[s].any()) and abs(r.N_set_expr_prob - prob[s].max()) < 1e-12
        assert r.N_set_expr_channel == ("" if prob[s].max() <= 0 else "any" if mode.stat == "any" else states[int(prob[s].argmax())])
        assert all(abs(r[f"N_set_branch_{b}_prob"] - min(v[b, s].max(), 1)) < 1e-12 for b in named)
        if "A" in text:
            others = [b for b in branches if b not in named]
            assert r.N_set_other == bool((A[s] >= 0.6).any()) and abs(r.N_set_other_prob - A[s].max()) < 1e-12 and abs(r.S_set_other_prob - T[others, s].sum((1, 2)).max()) < 1e-12
        else:
            assert "N_set_other" not in r.asDict()


def test_urn_expectations_of_all_features(spark):
    rng = np.random.default_rng(2)
    rows = [(b, s, 0, "AC"[rng.integers(2)], "GT"[rng.integers(2)], float(rng.uniform(0.2, 1))) for b in range(4) for s in range(9) if rng.random() < 0.7]
    events = spark.createDataFrame(rows, "branch_id int, site int, grp int, a string, d string, pp double")
    w = rng.dirichlet(np.ones(9), 4)
    weights = spark.createDataFrame([(b, s, float(w[b, s])) for b in range(4) for s in range(9)], "branch_id int, site int, weight double")
    stats = ("any2any", "any2spe")
    draws = omega_null.feature_draws(events, stats)
    n = {tuple(r[:-1]): r.n for r in draws.collect()}
    combos = {k: spark.createDataFrame(list(combinations(range(4), k)), ", ".join(f"{c} int" for c in combine.ids(k))) for k in (2, 3)}

    def inclusion(law, b, x):
        if law == "independent":
            return x * w[b]
        f = expected.fisher_inclusion if law == "fisher" else expected.wallenius_inclusion
        return (1 - x % 1) * f(w[b], int(x)) + x % 1 * f(w[b], int(x) + 1)

    for law, k in (("independent", 2), ("independent", 3), ("fisher", 2), ("wallenius", 2)):
        urns = {"N": expected.urn_projections(weights, draws, law)}
        got = rates.observed_and_expected({"N": events}, {}, combos[k], k, stats, urns=urns).collect()
        for r in got:
            for s in stats:
                of = {f[1:] for f in n if f[1] == s}
                want = sum(math.prod(inclusion(law, b, n[(b, *f)])[site] if (b, *f) in n else 0 for b in r[:k]) for f in of for site in range(9))
                assert r[f"ECN{s}"] == pytest.approx(want, abs=1e-9)
    totals = {"N": events.groupBy("site", F.lit("any2spe").alias("stat"), "grp", F.lit("").alias("a"), "d").agg(F.sum("pp").alias("sub"))}
    present = weights.select("branch_id", "site")
    each = summaries.site_rates(totals, "each", 9, present, 0.5)["N"].collect()
    own = {(r.site, r.d): r["sub"] for r in totals["N"].collect()}
    assert len(each) == 4 * 9 * 2
    for r in each:
        column = [own.get((s, r.d), 0) + 0.5 for s in range(9)]
        assert r.weight == pytest.approx(column[r.site] / sum(column))


def test_clade_p_and_small_tables(spark, tree):
    nodes, up = tree
    rounds = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 3.0, float("inf"), float("nan"), None])], "round int, median double")
    p = permute.summary_p(rounds, 2.0).first()
    assert (p.n, p.as_large, p.p, p.median, p["mean"]) == (4, 3, 0.75, 2.5, 2.0)
    d = {(r.x, r.y): (r.dist, r.steps) for r in combine.branch_distances(up).collect()}
    assert d[5, 6] == (pytest.approx(0.5), 2) and d[1, 5] == (pytest.approx(0.1 + 0.7 + 0.8 + 0.4), 5) and d[4, 5] == (pytest.approx(0.0), 1) and len(d) == 36
    kept = spark.createDataFrame([(1, 0), (3, 1)], "site int, new int")
    assert [tuple(r) for r in J.site_index_map(kept, 4).orderBy("codon_site_alignment").collect()] == [(0, 1, -1, 0, "N"), (1, 2, 0, 1, "Y"), (2, 3, -1, 0, "N"), (3, 4, 1, 2, "Y")]
    scores = spark.createDataFrame([(1, -2.0, 0.3), (1, -1.0, 0.9), (2, -2.0, 0.4), (3, -5.0, 0.1), (4, float("nan"), 1.0), (5, None, 1.0), (6, -2.0, 0.9)], "site int, score double, pp double")
    assert [r.site for r in J.score_sites(scores, 3).collect()] == [1, 3, 6]
    sets = spark.createDataFrame([("t", [1, 2]), ("t", [2, 5]), ("u", [1, 2]), ("u", [2, 6]), ("v", [6, 3, 1])], "trait string, members array<int>")
    clash = spark.createDataFrame([(3, 6)], "lo int, hi int")
    assert {tuple(r) for r in combine.trait_unions(sets, 3).collect()} == {(1, 2, 5), (1, 2, 6), (1, 3, 6)} and {tuple(r) for r in combine.trait_unions(sets, 3, clash).collect()} == {(1, 2, 5), (1, 2, 6)}
    e = spark.createDataFrame([(1, 0.5), (2, 0.0)], "branch_id int, pp double")
    assert {r.branch_id for r in combine.active_branches(e, e.withColumn("branch_id", F.col("branch_id") + 5)).collect()} == {1, 6}
    t = lambda rows: spark.createDataFrame(rows, "trait string, branch_id int")
    b = traits.label_branches(spark.createDataFrame([(1,), (2,)], "branch_id int"), t([("x", 1)]), t([("y", 1), ("x", 2)]))
    assert {r.branch_id: (r.is_fg_x, r.is_mg_x, r.is_fg_y, r.is_mg_y) for r in b.collect()} == {1: ("Y", "N", "N", "Y"), 2: ("N", "Y", "N", "N")}
    c = spark.createDataFrame([("A", "G", 7, "spe2spe"), ("any", "G", 7, "any2spe"), ("A", "dif", 7, "spe2dif"), ("A,C", "any", 7, "dif2any")], "x string, y string, s int, m string")
    assert [r[0] for r in c.select(sequence.state_change(F.col("x"), F.col("y"), F.col("s"), F.col("m"))).collect()] == ["A7G", "7G", "A7", "7:dif2any"]


def test_simulated_counts(spark):
    df = spark.createDataFrame([(i, 2.0 + i) for i in range(3)], "i int, m double")
    rows = nulls.simulated_counts(df, ["i"], "m", 400, 0.5).collect()
    again = nulls.simulated_counts(df.repartition(3), ["i"], "m", 400, 0.5).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again)) and len(rows) == 1200
    for i in range(3):
        x = np.array([r["count"] for r in rows if r.i == i])
        assert abs(x.mean() - 2 - i) < 0.6 and abs(x.var() - (2 + i) * (1 + 0.5 * (2 + i))) < 4
