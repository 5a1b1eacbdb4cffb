"""Column planning, report parsers, trees, permutations and text fields against values worked out by hand."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.functions import numeric, recoding, sequence, text
from cladewise.operators import combine, events as ev, expected, nulls, permute, pseudocounts as pc, rates, site_tables, states as st, summaries
from cladewise.plans import cutoff, set_expression, statistics
from cladewise.sources import fasta, reports, tables


def test_statistics():
    assert statistics.parse(" any2spe,ANY2DIF, any2spe") == ["any2spe", "any2dif"] and statistics.parse(None) == list(statistics.DEFAULT)
    assert statistics.required_base("any2dif") == ["any2any", "any2spe"] and statistics.required_base("dif2dif") == list(statistics.BASE)
    assert statistics.required_differences("dif2dif") == ["any2dif", "dif2dif", "spe2dif"] and statistics.required_differences("any2any") == []
    assert statistics.default_cutoff("dif2any,any2any") == "OCNany2any,2.0|omegaCany2any,5.0"
    statistics.check_cutoff("OCNany2spe,2|nonsense", "any2spe")
    for bad in ("", "any2all"):
        with pytest.raises(ValueError):
            statistics.parse(bad)
    with pytest.raises(ValueError):
        statistics.check_cutoff("OCN(any2spe|any2dif),2", "any2spe")
    columns = ["x", "ECNany2spe", "OCNany2dif", "OCNany2any", "dNCany2any_nocalib", "dNCany2any", "omegaCany2any", "is_fg", "branch_id_10", "branch_id_2", "dist_bl"]
    assert statistics.ordered_columns(columns) == ["branch_id_2", "branch_id_10", "dist_bl", "is_fg", "omegaCany2any", "dNCany2any", "OCNany2any", "OCNany2dif", "ECNany2spe", "dNCany2any_nocalib", "x"]
    assert statistics.requested_columns(columns, "any2dif") == ["x", "OCNany2dif", "is_fg", "branch_id_10", "branch_id_2", "dist_bl"]
    assert statistics.summary_columns(["mode", "z", "num_b", "arity"]) == ["arity", "mode", "num_b", "z"]


def test_column_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a_PLACEHOLDER int, OCNany2spe int, b int")
    assert statistics.without_placeholders(df).columns == ["a", "OCNany2spe", "b"] and statistics.single_branch(df).columns == ["a_PLACEHOLDER", "b"]


def test_cutoffs_are_strict():
    assert cutoff.parse("'a{1|2}',1||\"b\",2") == [("a{1|2}", 1.0), ("b", 2.0)]
    for bad in ("a,nan", "a,inf", "|", "a,", ",1", "(,1"):
        with pytest.raises((ValueError, Exception)):
            cutoff.parse(bad)


def test_set_probabilities_are_masked(spark):
    assert set_expression.tokens("a - 1") == ["A", "-", "1"]
    df = spark.createDataFrame([(True, 0.9, False, 0.8), (False, 0.7, False, 0.6), (True, 0.5, True, float("nan"))], "m boolean, p double, n boolean, q double")
    v = {1: set_expression.Value(F.col("m"), F.col("p")), 2: set_expression.Value(F.col("n"), F.col("q"))}
    for text_, want in (("1|2", [0.9, 0, 0.5]), ("1-2", [0.9, 0, 0]), ("1^2", [0.9, 0, 0]), ("1&2", [0, 0, 0])):
        assert [r[0] for r in df.select(set_expression.compile_expression(text_, v, v[1]).probability).collect()] == want


def test_g_test(spark):
    row = spark.createDataFrame([(3.0, 7.0, 60.0, 40.0), (0.0, 0.0, 5.0, 5.0)], "n1 double, s1 double, n2 double, s2 double")
    c = [F.col(x) for x in row.columns]
    got = row.select(rates.g_test(*c).alias("g"), rates.g_test_p(*c).alias("p")).collect()
    a = np.array([[3.5, 6.5], [59.5, 40.5]])
    e = a.sum(1)[:, None] * a.sum(0)[None, :] / a.sum()
    g = 2 * (a * np.log(a / e)).sum()
    assert math.isclose(got[0].g, g) and math.isclose(got[0].p, math.erfc(math.sqrt(g / 2))) and (got[1].g, got[1].p) == (0, 1)


def test_significant_digits(spark):
    values = [0.0, 1.0, 0.1, 123456.0, 1234567.0, 0.0001, 0.00001234567, 2.5e-7, 99999.94, 999999.6, -3.14159265, 1e300, 100.0]
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert [r[0] for r in df.select(numeric.significant(F.col("x"))).collect()] == ["%.6g" % v for v in values]


def test_significant_digits_of_decimal_ties(spark):
    """17820.35 lies below the tie in binary, 0.5 beyond six digits goes to the even one."""
    values = [17820.35, 17820.45, 17820.25, 100000.5, 100001.5, 1234.565, 1234.575, 1000000.5, 12345650.0]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    assert [r[0] for r in df.select(numeric.significant(F.col("x"))).collect()] == ["%.6g" % v for v in values] + [None]



def test_fasta_headers(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a one > two\nAC\nGT\n>b\nTT\n")
    assert [(r.description, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / "x.fa")).collect()] == [("a one > two", "ACGT"), ("b", "TT")]
    assert fasta.read_fasta(spark, str(tmp_path / "x.fa"), "seq_id").count() == 2
    (tmp_path / "y.fa").write_text(">a 1\nAC\n>a 2\nGT\n")
    assert fasta.read_fasta(spark, str(tmp_path / "y.fa"), "description").count() == 2
    with pytest.raises(Exception, match="duplicate"):
        fasta.read_fasta(spark, str(tmp_path / "y.fa"), "seq_id").collect()


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1.0, 1.0, 2.5), (2.0, 0.5, 3.0)], "N_sub double, OCNany2any double, x double")
    tables.write_tsv(df, str(tmp_path / "o"))
    tables.write_tsv(df, str(tmp_path / "o"), append=True)
    lines = spark.read.text(str(tmp_path / "o")).where("value not like 'N_sub%'").collect()
    assert sorted(r[0] for r in lines) == ["1\t1.0000\t2.5000"] * 2 + ["2\t0.5000\t3.0000"] * 2
    (tmp_path / "r").write_text("# c\nSite\tRate\tC_Rate\n1\t0.5\t1\n2\t1.5\t2\n")
    assert [tuple(r) for r in tables.read_rates(spark, str(tmp_path / "r")).collect()] == [(0, 0.5), (1, 1.5)]
    (tmp_path / "r2").write_text("Site\tC_Rate\n1\t0.5\n3\t1.5\n")
    with pytest.raises(ValueError):
        tables.read_rates(spark, str(tmp_path / "r2"))


def test_reports(spark, tmp_path):
    (tmp_path / "i").write_text("IQ-TREE multicore version 2.1.4 built\n  Model of substitution: GY+F3X4 \npi(AAA) = 0.25\npi( AAC ) = 7.5e-1\npi(AAA) = 0.9\n")
    got = reports.read_report(spark, str(tmp_path / "i"), ["AAC", "AAA"])
    assert (got["version"], got["major"], got["model"]) == ("2.1.4", 2, "GY+F3X4") and np.allclose(got["frequencies"], [0.75, 0.25])
    with pytest.raises(ValueError):
        reports.read_report(spark, str(tmp_path / "i"), ["AAA", "TTT"])
    (tmp_path / "l").write_text("Converting to codon sequences with genetic code 2 ...\nNonsynonymous/synonymous ratio (omega): 0.5\n Transition/transversion ratio (kappa): 2e0\nNonsynonymous/synonymous ratio (omega): 0.25\n")
    assert reports.read_log(spark, str(tmp_path / "l")) == {"omega": 0.25, "kappa": 2.0, "genetic_code": 2}
    n = 0
    lines = []
    for i in range(1, 61):
        lines.append(" ".join(str(n + k) for k in range(i)))
        n += i
    (tmp_path / "d").write_text("\n".join([*lines, "", " ".join(["0.01"] * 60 + ["0.4"])]) + "\n")
    order = reports.exchange_codons()
    m, f = reports.read_exchangeabilities(spark, str(tmp_path / "d"), order[::-1])
    assert m.shape == (61, 61) and (m == m.T).all() and m[60, 59] == 0 and m[60, 58] == 1 and m[59, 58] == 2 and f[0] == 0.4
    (tmp_path / "m").write_text(">s1\n# letter, own, aln\nM, 1, 2\nK, -, 3\nA, 2, -\n>s2\n")
    assert sorted(tuple(r) for r in reports.read_coordinate_map(spark, str(tmp_path / "m")).collect()) == [("s1", 2, 1, "M"), ("s1", 3, 0, "")]
    (tmp_path / "g").write_text("site\tdegree\n1\t2\n1\t4\n3\t1\n")
    assert [r.degree for r in reports.read_site_degrees(spark, str(tmp_path / "g"), 4).orderBy("site").collect()] == [3, 0, 1, 0]


def test_codon_rates():
    codons = ["AAA", "AAG", "AAC", "TTT"]  # K, K, N, F
    pi = np.array([0.1, 0.2, 0.3, 0.4])
    q = reports.codon_rates(codons, pi, omega=0.5, kappa=2.0)
    assert np.allclose(q.sum(axis=1), 0) and math.isclose(-(pi @ np.diag(q)), 1.0)
    assert math.isclose(q[0, 1] / q[0, 2], (2.0 * 0.2) / (0.5 * 0.3)) and q[0, 3] == q[3, 0] == 0


TREE = [(1, 11), (2, 11), (3, 12), (4, 12), (11, 20), (12, 20), (5, 20), (20, None)]


def test_trees(spark):
    nodes = spark.createDataFrame(TREE, "node int, parent int")
    closed = st.ancestors(nodes)
    assert {tuple(r) for r in closed.where("node = 1").collect()} == {(1, 11, 1), (1, 20, 2)}
    assert [r.branch_id for r in permute.lineage_path(closed, 20, 3).orderBy("depth").collect()] == [12, 3]
    assert permute.lineage_path(closed, 11, 3).count() == 0
    have = nodes.where("node not in (11, 5)").select("node")
    assert {tuple(r) for r in st.effective_parents(nodes, have).collect()} == {(1, 20), (2, 20), (3, 12), (4, 12), (12, 20), (5, 20)}
    present = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (1, 1), (4, 2)], "leaf int, site int")
    # node 11: clades 1, 2 and the sisters 12, 5; node 12: 3, 4 and 11, 5
    assert {tuple(r) for r in st.informative_sites(nodes, present).collect()} == {(11, 0), (11, 1), (12, 1)}
    best = spark.createDataFrame([(1, 0, "A"), (1, 2, "C")], "node int, site int, state string")
    assert st.state_strings(best, 4).first().sequence == "A-C-"
    clades = spark.createDataFrame([("x", "a"), ("x", "b"), ("r", "a"), ("r", "b"), ("r", "c")], "clade string, leaf string")
    other = spark.createDataFrame([("p", "b"), ("p", "a"), ("q", "a"), ("q", "b"), ("q", "c")], "clade string, leaf string")
    assert permute.same_topology(clades, other) and not permute.same_topology(clades, other.where("clade = 'q'"))


def test_random_stems(spark):
    assert permute.clade_bins([1, 1, 1, 2, 3, 9], 2) == [10, 3, 1] and permute.clade_bins([], 2) == [0, 0] and permute.clade_bins([4, 2], 9) == [2, 4]
    nodes = [(1, 11, 1), (2, 11, 1), (3, 12, 1), (4, 12, 1), (11, 20, 2), (12, 20, 2), (5, 20, 1), (20, None, 5)]
    drawn = permute.random_stems(spark, nodes, {11, 5}, 40, least=2, original=True)
    sets = {}
    for r in drawn.collect():
        sets.setdefault(r["round"], set()).add(r.branch_id)
    assert len(sets) == 40 and len({frozenset(s) for s in sets.values()}) > 2
    for s in sets.values():
        assert len(s & {11, 12}) == 1 and len(s & {1, 2, 3, 4, 5}) == 1 and not (11 in s and s & {1, 2}) and not (12 in s and s & {3, 4})
    again = permute.random_stems(spark, nodes, {11, 5}, 40, least=2, original=True).repartition(3)
    assert {(r["round"], r.branch_id) for r in again.collect()} == {(k, b) for k, s in sets.items() for b in s}
    assert all(not s & {11, 5} for s in [{r.branch_id for r in permute.random_stems(spark, nodes, {11, 5}, 5, least=1).collect()}])


def test_random_combinations(spark):
    pairs = {(1, 2), (3, 4)}
    got = [tuple(r) for r in permute.random_combinations(spark, [1, 2, 3, 4, 5], pairs, 3, 100).collect()]
    every = {c for c in combinations(range(1, 6), 3) if not any(p[0] in c and p[1] in c for p in pairs)}
    assert set(got) == every and len(got) == len(every)  # all there are, each once
    assert permute.random_combinations(spark, [1, 2, 3, 4, 5], pairs, 2, 3).count() == 3
    full = spark.createDataFrame(list(combinations(range(4), 2)), "branch_id_1 int, branch_id_2 int")
    assert permute.is_complete_family(full, 2) and not permute.is_complete_family(full.where("branch_id_2 < 3 or branch_id_1 = 0"), 2)


def test_closed_forms_equal_events(spark):
    rng = np.random.default_rng(4)
    rows = [(b, s, g, k, float(rng.random())) for b in range(3) for s in range(4) for g in range(2) for k in range(3)]
    schema = "branch_id int, site int, grp int, state string, p double"
    up = spark.createDataFrame([(b, s, g, "xyz"[k], p) for b, s, g, k, p in rows], schema)
    down = spark.createDataFrame([(b, s, g, "xyz"[k], p / 2 + 0.1) for b, s, g, k, p in rows if k != s % 3], schema)
    tensor = up.selectExpr("branch_id", "site", "grp", "state as a", "p as pa").join(down.selectExpr("branch_id", "site", "grp", "state as d", "p as pd"), ["branch_id", "site", "grp"]).where("a <> d").withColumn("pp", F.expr("pa * pd"))
    keys = ["branch_id", "site", "stat", "grp", "a", "d"]
    want = {tuple(r[c] for c in keys): r.v for r in ev.projections(tensor).collect()}
    got = {tuple(r[c] for c in keys): r.v for r in expected.closed_form_projections(up, down).collect()}
    assert set(got) == set(want) and all(math.isclose(got[k], want[k], rel_tol=1e-9) for k in want)
    cb = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.25)], "branch_id_1 int, branch_id_2 int, ECNany2any double")
    nan = combine.nan_below_root(cb, spark.createDataFrame([(3,)], "branch_id int"), 2).orderBy("branch_id_1").collect()
    assert nan[0].ECNany2any == 0.5 and math.isnan(nan[1].ECNany2any)


def test_urn_overlap(spark):
    w = spark.createDataFrame([(b, s, 0.25) for b in (0, 1) for s in range(4)], "branch_id int, site int, weight double")
    n = spark.createDataFrame([(0, 1.5), (1, 2.0)], "branch_id int, n double")
    pairs = spark.createDataFrame([(0, 1)], "branch_id_1 int, branch_id_2 int")
    for law in ("fisher", "wallenius"):
        assert math.isclose(expected.urn_overlap(w, n, pairs, law).first().expected, 4 * (1.5 / 4) * (2 / 4))


def test_site_rates(spark):
    totals = {c: spark.createDataFrame([(0, x), (1, 3.0)], "site int, sub double") for c, x in (("N", 1.0), ("S", 5.0))}
    have = spark.createDataFrame([(7, 0), (7, 1), (8, 1), (9, 2)], "branch_id int, site int")
    get = lambda mode, c="N", **k: {(r.branch_id, r.site): r.weight for r in summaries.site_rates(totals, mode, 3, have, **k)[c].collect()}
    assert get("no") == {(7, 0): 0.5, (7, 1): 0.5, (8, 1): 1.0, (9, 2): 1.0} and get("pool") == {(7, 0): 0.5, (7, 1): 0.5, (8, 1): 1.0, (9, 2): 1.0}
    assert get("sn") == {(7, 0): 0.25, (7, 1): 0.75, (8, 1): 1.0, (9, 2): 1.0} and get("sn", "S", alpha=1.0)[7, 0] == 0.6
    assert get("file", file_rates=spark.createDataFrame([(0, 1.0), (1, 4.0)], "site int, rate double"))[7, 1] == 0.8
    with pytest.raises(ValueError):
        get("each")


def test_text_fields(spark):
    df = spark.createDataFrame([("AF-P12345-F1", " 12.0", "A-C-", "xy"), ("sp|Q9NZC2|X", "0", "--", ""), ("none", "1a", "AC", "x"), ("k_A0A024RBG1", "+7", "", "")], "n string, r string, g string, p string")
    got = df.select(text.accession(F.col("n")), text.residue_number(F.col("r")), text.with_gaps(F.col("g"), F.col("p")), text.species_label(F.col("n"), "(^[a-z]+)[|]|(one)", 2)).collect()
    assert [tuple(r) for r in got] == [("P12345", 12, "x-y-", None), ("Q9NZC2", None, "--", "sp"), (None, None, None, "one"), ("A0A024RBG1", 7, "", None)]
    assert text.combinations_count(30, 15) == math.comb(30, 15) and text.combinations_count(2, 3) == 0
    labels = spark.createDataFrame([([],), (["A"],), (["A", "C"],), (["A", "C", "G"],)], "s array<string>").select(text.state_label(F.col("s"), 3)).collect()
    assert [r[0] for r in labels] == ["", "A", "dif", "any"]


def test_site_tables(spark):
    a = spark.createDataFrame([(1, "M"), (2, "-"), (3, "K")], "site int, residue string").withColumn("seq_id", F.lit("s"))
    sites = spark.range(1, 5).selectExpr("cast(id as int) as site")
    got = site_tables.add_gene_index(sites, site_tables.gene_index(a), "s").orderBy("site").collect()
    assert [r.gene_site_s for r in got] == [1, 0, 2, 0]
    probs = spark.createDataFrame([(1, True, 0.5), (2, True, 0.0), (3, False, 0.9), (4, True, 0.7)], "site int, m boolean, p double")
    assert [r.site for r in site_tables.set_sites(probs, "m", "p", 5).collect()] == [4, 1]
    numbered = site_tables.row_numbers(spark.range(1000).selectExpr("id * 7 % 1000 as k"), ["k"]).collect()
    assert all(r.k == r.number for r in numbered)


def test_pseudocounts(spark):
    assert pc.Pseudocount.of("auto", "Empirical").enabled and not pc.Pseudocount.of("0", "symmetric").enabled
    for bad in (("-1", "none"), ("nan", "none"), ("1", "odd"), ("x", "none")):
        with pytest.raises(ValueError):
            pc.Pseudocount.of(*bad)
    masses = {"any2any": 10.0, "spe2any": 6.0, "any2spe": 4.0, "spe2spe": 3.0}  # ss 3, sd 3, ds 1, dd 3
    got = pc.stat_alphas(masses, "any2spe,dif2dif,any2any", 2.0)
    assert np.allclose([got["any2spe"], got["dif2dif"], got["any2any"]], [0.8, 0.6, 2.0])
    assert pc.stat_alphas({}, "any2spe", 2.0) == {"any2spe": 1.0} and pc.stat_alphas(masses, "any2spe", 2.0, "symmetric") == {"any2spe": 2.0}
    cb = spark.createDataFrame([(0.0, 0.0, 1.0, 2.0), (1.0, 3.0, 0.0, 0.0)], "OCNx double, ECNx double, OCSx double, ECSx double")
    raw = pc.add_smoothed_rates(cb, {"x": 0.0}).collect()
    assert [raw[0].dNCx_smoothed, raw[0].omegaCx_smoothed, raw[1].dSCx_smoothed, raw[1].omegaCx_smoothed] == [0.0, 0.0, 0.0, math.inf]
    one = pc.add_smoothed_rates(cb, {"x": 1.0}, "expected").collect()
    assert [one[0].dNCx_smoothed, one[1].dNCx_smoothed, one[1].dSCx_smoothed] == [0.0, 0.25, 0.0]


def test_codes_and_schemes():
    assert sequence.genetic_code(22)["TCA"] == "*" and sequence.genetic_code(26)["CTG"] == "A" and sequence.genetic_code(14)["TAG"] == "*"
    for name, groups in recoding.SCHEMES.items():
        assert sorted("".join(groups)) == sorted(recoding.SCHEMES["none"]), name
    assert recoding.classes("Dayhoff-18")["M"] == "ML" and recoding.classes("d6")["C"] == "C" and recoding.classes("no")["A"] == "A"


def test_unions_and_nulls(spark):
    sets = spark.createDataFrame([([1, 2],), ([2, 3],), ([5, 6],), ([7, 8, 9],), ([2, 1],)], "members array<int>")
    assert {tuple(r) for r in combine.unions(sets, 3).collect()} == {(1, 2, 3), (7, 8, 9)}
    w = spark.createDataFrame([(b, s, 0.5) for b in (0, 1) for s in (0, 1)], "branch_id int, site int, weight double")
    n = spark.createDataFrame([(0, 4.0), (1, 6.0)], "branch_id int, sub double")
    got = nulls.poisson_overlaps(w, n, spark.createDataFrame([(0, 1)], "branch_id_1 int, branch_id_2 int"), 3000)
    assert abs(got.agg(F.avg("count")).first()[0] - 12.0) < 0.3  # 4 * 6 * 2 * 0.25
    z = spark.createDataFrame([(float(x),) for x in range(101)], "z double")
    assert nulls.automatic_clip(z, "z", 0.02) == pytest.approx(1.99) and nulls.automatic_clip(z, "z", 0.0) == 1.5 and nulls.automatic_clip(z, "z", 1.0) == 5.0


def test_staged_p(spark):
    """Rows go on only while their p is coarse, and rounds are not drawn twice."""
    observed = spark.createDataFrame([(0, 5), (1, 50), (2, 1000)], "k int, v int")
    asked = []

    def draw(rows, first, last):
        asked.append((sorted(r.k for r in rows.collect()), first, last))
        return rows.withColumn("round", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("v", F.col("round"))

    got = {r.k: (r.ge, r.n, r.p) for r in rates.staged_p(observed, ["k"], "v", draw, (10, 60, 100), 5).collect()}
    assert got == {0: (6, 10, 7 / 11), 1: (11, 60, 12 / 61), 2: (0, 100, 1 / 101)}
    assert asked == [([0, 1, 2], 1, 10), ([1, 2], 11, 60), ([2], 61, 100)]
    for bad in ((), (5, 5), (0,)):
        with pytest.raises(ValueError):
            rates.staged_p(observed, ["k"], "v", draw, bad)


def test_general_eigenvectors(spark):
    q = np.array([[-3.0, 2, 1], [0.5, -1, 0.5], [1, 3, -4]])
    left, values, right = expected.eigen_general(q)
    step, term = np.eye(3), np.eye(3)
    for k in range(1, 60):
        term = term @ q * 0.3 / k
        step = step + term
    assert np.allclose(((left * np.exp(values * 0.3)) @ right).real, step)
    with pytest.raises(ValueError):
        expected.eigen_general(np.array([[-1.0, 1, 0], [0, -1, 1], [0, 0, -1]]))
    got = expected.expected_states(spark.createDataFrame([(1, 0, [1.0, 0.0, 0.0], 0.3, 1.0)], "branch_id int, site int, p array<double>, t double, rate double"), q).first().p
    assert np.allclose(got, step[0])


def test_ungapped_translation(spark):
    df = spark.createDataFrame([("ATGAAAUAA",), ("",)], "s string")
    assert [r[0] for r in df.select(sequence.translate_ungapped(F.col("s"))).collect()] == ["MK*", ""]
    for bad in ("ATGA", "AT-"):
        with pytest.raises(Exception, match="codon|length"):
            spark.createDataFrame([(bad,)], "s string").select(sequence.translate_ungapped(F.col("s"))).collect()
