"""Empirical p of omegaC against plain counting over the same drawn sites."""

import math
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest

from cladewise.operators import omega_null
from cladewise.operators.combine import ids

NAN = float("nan")
STATS = ("any2spe", "any2dif", "any2any")


def toy(spark, k):
    rng = np.random.default_rng(4)
    events = {c: [(b, s, g, "AC"[rng.integers(2)], "GT"[rng.integers(2)], float(rng.uniform(0.2, 1))) for b in range(5) for s in range(12) for g in range(1 if c == "N" else 2) if rng.random() < 0.6] for c in "NS"}
    events = {c: spark.createDataFrame(v, "branch_id int, site int, grp int, a string, d string, pp double") for c, v in events.items()}
    weights = spark.createDataFrame([(b, s, float(rng.uniform(0.1, 1))) for b in range(5) for s in range(12)], "branch_id int, site int, weight double")
    rows = []
    for c in combinations(range(5), k):
        e = [[round(float(v), 3) for v in rng.uniform(0.1, 2, len(STATS))] for _ in "NS"]
        if c[:2] == (0, 1):
            e[1][0] = NAN
        if c[:2] == (0, 2):
            e[1][1] = 0.0
        rows.append((*c, *e[0], *e[1], *[NAN if c[:2] == (1, 2) else float(round(rng.uniform(0, 2), 2)) for _ in STATS]))
    names = [*ids(k), *[f"EC{c}{s}" for c in "NS" for s in STATS], *[f"omegaC{s}" for s in STATS]]
    cb = spark.createDataFrame(rows, ", ".join(f"{n} {'int' if n in ids(k) else 'double'}" for n in names))
    draws = {c: omega_null.feature_draws(e, STATS) for c, e in events.items()}
    return cb, {c: weights for c in "NS"}, draws


def rate(o, e):
    if o < 1e-9:
        return 0.0
    return math.inf if e == 0 and not math.isnan(o) else o / (e or 1)


def plain(cb, drawn, k, total, calibrated):
    """{combination: {statistic: omegas by round}} by plain counting."""
    held = {c: defaultdict(set) for c in "NS"}
    for c in "NS":
        for r in drawn[c]:
            held[c][r["round"], r.branch_id, r.stat].add((r.grp, r.a, r.d, r.site))
    out = {tuple(r[:k]): {s: [] for s in STATS} for r in cb}
    for n in range(1, total + 1):
        table = {}
        for r in cb:
            m = tuple(r[:k])
            o = {c: {s: float(len(set.intersection(*[held[c][n, b, s] for b in m]))) for s in ("any2any", "any2spe")} for c in "NS"}
            for c in "NS":
                d = o[c]["any2any"] - o[c]["any2spe"]
                o[c]["any2dif"] = NAN if d < 0 else d
            table[m] = {s: [rate(o[c][s], r[f"EC{c}{s}"]) for c in "NS"] for s in STATS}
        for s in STATS:
            if calibrated:
                fit = [m for m in table if all(math.isfinite(v) for v in table[m][s])]
                y = [table[m][s][1] for m in fit]
                rank = [sum(v < w for v in y) + (sum(v == w for v in y) + 1) / 2 for w in y]
                for m, q in zip(fit, np.quantile([table[m][s][0] for m in fit], (np.array(rank) - 0.5) / len(fit))):
                    table[m][s][1] = max(table[m][s][1], float(q))
            for m, v in table.items():
                out[m][s].append(rate(*v[s]))
    return out


@pytest.mark.parametrize("k, calibrated", [(2, False), (2, True), (3, False)])
def test_pvalues_against_plain_counts(spark, k, calibrated):
    cb, weights, draws = toy(spark, k)
    schedule, edge = ((6,) if calibrated else (6, 20)), 2
    got = omega_null.omega_pvalues(cb, weights, draws, k, STATS, schedule, edge, calibrated, seed=9).collect()
    rows = cb.collect()
    parts = [(1, 6), (7, 20)][: len(schedule)]
    drawn = {c: [r for a, b in parts for r in omega_null.drawn_sites(weights[c], draws[c], a, b, 18 + i).collect()] for i, c in enumerate("NS")}
    omegas = plain(rows, drawn, k, schedule[-1], calibrated)
    p = {s: {} for s in STATS}
    by = {tuple(r[:k]): r for r in rows}
    count = lambda m, s, n: (sum(v >= by[m][f"omegaC{s}"] for v in omegas[m][s][:n] if not math.isnan(v)), sum(not math.isnan(v) for v in omegas[m][s][:n]))
    for m, r in by.items():
        able = {s: not math.isnan(r[f"omegaC{s}"]) and math.isfinite(r[f"ECS{s}"]) for s in STATS}
        go = any(able[s] and (count(m, s, 6)[0] <= edge or not count(m, s, 6)[1]) for s in STATS)
        for s in STATS:
            ge, n = count(m, s, schedule[-1] if go else 6)
            p[s][m] = (ge + 1) / (n + 1) if able[s] and n else NAN
    assert {tuple(r[:k]) for r in got} == set(by)
    for r in got:
        for s in STATS:
            want = p[s][tuple(r[:k])]
            assert r[f"pomegaC{s}"] == pytest.approx(want, nan_ok=True), (tuple(r[:k]), s)
            known = sorted(v for v in p[s].values() if not math.isnan(v))
            q = NAN if math.isnan(want) else min(1.0, min(v * len(known) / (i + 1) for i, v in enumerate(known) if v >= want - 1e-12 and (i + 1 == len(known) or known[i + 1] > v)))
            assert r[f"qomegaC{s}"] == pytest.approx(q, nan_ok=True)


def test_draws(spark):
    _, weights, draws = toy(spark, 2)
    weights = weights["N"]
    drawn = omega_null.drawn_sites(weights, draws["N"], 3, 42, 5).collect()
    n = {tuple(r[:-1]): r.n for r in draws["N"].collect()}
    sizes = defaultdict(int)
    for r in drawn:
        sizes[tuple(r[:5]), r["round"]] += 1
    assert len({(tuple(r[:5]), r["round"], r.site) for r in drawn}) == len(drawn) and {r["round"] for r in drawn} == set(range(3, 43))
    for key, m in n.items():
        of = [sizes[key, i] for i in range(3, 43)]
        assert set(of) <= {math.floor(m), math.floor(m) + 1} and abs(np.mean(of) - m) < 0.35
    again = omega_null.drawn_sites(weights.repartition(7), draws["N"].repartition(3), 3, 42, 5).collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, drawn))
    assert omega_null.drawn_sites(weights, draws["N"].limit(0), 1, 3).count() == 0
