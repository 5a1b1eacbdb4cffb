"""Languages, sources, traits, scan and site operators on small tables."""

import gzip
import math

import pytest
from pyspark.sql import functions as F

from cladewise.functions import sequence
from cladewise.operators import scan, sites, traits
from cladewise.plans import cutoff, set_expression
from cladewise.sources import ancestral, fasta, newick, tables
from cladewise.streaming.totals import streaming_totals


def test_cutoff(spark):
    assert cutoff.parse(r"OC(N|S)any,1.5|x\|y,2") == [("OC(N|S)any", 1.5), (r"x\|y", 2.0)]
    for bad in ("OCN", ",1", "x,y", "a(,1"):
        with pytest.raises(Exception):
            cutoff.parse(bad)
    df = spark.createDataFrame([(1.0, 2.0), (float("nan"), 3.0), (2.0, None), (float("inf"), 5.0)], "ab double, ac double")
    assert cutoff.qualified(df, "a.,1").count() == 2 and cutoff.qualified(df, "ab,1.5").count() == 2
    with pytest.raises(ValueError):
        cutoff.qualified(df, "zz,1")


def test_set_expressions(spark):
    df = spark.createDataFrame([(bool(i & 1), bool(i & 2), bool(i & 4)) for i in range(8)], "x boolean, y boolean, z boolean")
    value = lambda c: set_expression.Value(F.col(c), F.col(c).cast("double"))
    run = lambda t: [r[0] for r in df.select(set_expression.compile_expression(t, {1: value("x"), 2: value("y")}, value("z")).member).collect()]
    rows = [(bool(i & 1), bool(i & 2), bool(i & 4)) for i in range(8)]
    assert run("(1|2)-A") == [(x or y) and not z for x, y, z in rows]
    assert run("1^2") == [x != y for x, y, z in rows] and run("1|2|A") == [x or y or z for x, y, z in rows]
    for bad in ("1-2-A", "1^2|A", "1&", "(1", "1 2", "", "1+2"):
        with pytest.raises(ValueError):
            run(bad)


def test_newick(spark):
    root = newick.parse("((A:1,B:2)x/90:0.5,('C[1]':1,D:1)y:0.25);")
    assert sorted(n.name for n in root.leaves()) == ["A", "B", "C", "D"] and root.branch_id == 6
    rows = {r.name: r for r in newick.nodes(spark, root).collect()}
    assert rows["A"].node == 0 and rows["x"].dist == 0.5 and rows["A"].parent == rows["x"].node
    assert newick.closure(spark, root).where("anc = 6").count() == 4
    # pairs that are not ancestor and descendant: 15 - 4 = 11; without the sisters (A,B), (C,D), (x,y): 8
    assert newick.count_independent(root, 4)[1:] == [11, 6, 1] and newick.count_independent(root, 2, True)[1] == 8
    for bad in ("(A,B,C);", "((A,B);", "(A,A);"):
        with pytest.raises(ValueError):
            newick.parse(bad)
    names = newick.parse("(" + ",".join(["(" + ",".join(f"t{i}" for i in range(90)) + ")", "z"]) + ");")
    assert len({n.branch_id for n in names.walk()}) == 93


def test_fasta(spark, tmp_path):
    with gzip.open(tmp_path / "x.fa.gz", "wt") as f:
        f.write(">a first one\nATG---\nNNN\n>b\nATGTAATTR\n")
    r = fasta.read_fasta(spark, str(tmp_path / "x.fa.gz"))
    assert {x.seq_id: x.sequence for x in r.collect()} == {"a": "ATG---NNN", "b": "ATGTAATTR"}
    aa = {x[0]: x[1] for x in r.select("seq_id", sequence.translate_aligned(F.col("sequence"))).collect()}
    assert aa == {"a": "M-X", "b": "MXX"}
    fasta.write_fasta(r, str(tmp_path / "out"), 4)
    assert {x.description for x in fasta.read_fasta(spark, str(tmp_path / "out")).collect()} == {"a first one", "b"}
    assert fasta.duplicate_ids(r.union(r)).count() == 2 and fasta.residues(r).count() == 6
    assert ancestral.codon_frequencies(r).where("codon = 'ATG'").first().freq == 2 / 3
    assert sequence.compatible_codons("TTR") == ["TTA", "TTG"] and sequence.compatible_codons("NNN") == [] and sequence.compatible_codons("TAR") == []
    assert sequence.genetic_code(2)["TGA"] == "W" and len(sequence.genetic_code(1)) == 64


def test_state_and_rate_tables(spark, tmp_path):
    (tmp_path / "s").write_text("# comment\nNode\tSite\tState\tp_AAA\tp_AAC\nN1\t1\tAAA\t0.9\t0.1\nN1\t2\tAAC\t0\t1\nN2\t1\tAAA\t1\t0\n")
    s = tables.read_states(spark, str(tmp_path / "s"))
    assert s.count() == 4 and tables.read_states(spark, str(tmp_path / "s"), ["N2"]).count() == 1
    assert [r.node for r in tables.state_problems(s, 2).collect()] == ["N2"]
    (tmp_path / "r").write_text("# c\nSite\tCat\tC_Rate\n1\t1\t0.5\n2\t2\t1.5\n")
    assert [r.rate for r in tables.read_rates(spark, str(tmp_path / "r")).orderBy("site").collect()] == [0.5, 1.5]
    (tmp_path / "f1").write_text("1\tA.*\n\n2\tB\n")
    (tmp_path / "f2").write_text("name\tt1\tt2\nA.*\t1\t0\nB\t0\t2\n")
    assert tables.read_foreground(spark, str(tmp_path / "f1")).count() == 2
    assert {tuple(r) for r in tables.read_foreground(spark, str(tmp_path / "f2")).collect()} == {("t1", "1", "A.*"), ("t2", "2", "B")}
    tables.write_tsv(spark.createDataFrame([(1, 0.12345, True, [1, 2]), (2, float("nan"), False, [])], "i int, x double, f boolean, m array<int>"), str(tmp_path / "o"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part-*")))
    assert "1\t0.1235\tY\t1,2" in text and "2\t\tN\t" in text


def test_traits(spark):
    leaves = spark.createDataFrame([("xb",), ("b",), ("a",)], "name string")
    p = spark.createDataFrame([("t", "1", "a|b")], "trait string, lineage string, pattern string")
    assert {r.name for r in traits.foreground_leaves(leaves, p).collect()} == {"a", "b"}
    v = spark.createDataFrame([("0",), ("0.0",), (" ",), (None,), ("NaN",), ("1",), ("C4",)], "v string")
    assert [r[0] for r in v.select(traits.background_value(F.col("v"))).collect()] == [True] * 5 + [False] * 2
    nodes = spark.createDataFrame([(0, 4), (1, 4), (2, 5), (3, 5), (4, 6), (5, 6), (6, None)], "node int, parent int")
    closure = spark.createDataFrame([(0, 0), (1, 1), (2, 2), (3, 3), (4, 0), (4, 1), (5, 2), (5, 3)] + [(6, i) for i in range(4)], "anc int, leaf int")
    n = closure.groupBy("anc").count().withColumnRenamed("count", "n")
    fg = spark.createDataFrame([("t", "1", 0), ("t", "1", 1), ("t", "2", 2)], "trait string, lineage string, leaf int")
    b = traits.lineage_branches(fg, closure, n)
    assert {(r.lineage, r.branch_id) for r in b.collect()} == {("1", 0), ("1", 1), ("1", 4), ("2", 2)}
    stems = traits.stem_branches(b, nodes)
    assert {r.branch_id for r in stems.collect()} == {4, 2}
    assert {r.branch_id for r in traits.marginal_branches(stems, nodes).collect()} == {6, 5, 3}


def test_scan_on_four_leaves(spark):
    e = spark.createDataFrame([(0, 0, 0, "A", "G", 0.9), (2, 0, 0, "A", "G", 0.8)], "branch_id int, site int, grp int, a string, d string, pp double")
    c = scan.all_candidates(e)
    assert {r.match for r in c.collect()} == {"any2any", "any2spe", "spe2any", "spe2spe"}
    units = spark.createDataFrame([("1", 0), ("2", 2)], "unit string, branch_id int")
    s = scan.support(c.where("match = 'spe2spe'"), e, units, 0.5, scan.support_threshold("1.0", 2)).first()
    assert (s.units, list(s.unit_ids), round(s.mean_mass, 6)) == (2, ["1", "2"], 0.85)
    b = spark.createDataFrame([(i, i in (0, 2), 1.0) for i in range(6)], "branch_id int, target boolean, exposure double")
    r = scan.with_p(scan.enrichment(c.where("match = 'spe2spe'"), e, b)).first()
    assert r.ratio == float("inf") and r.lrt > 0 and 0 < r.p < 0.5
    assert scan.support_threshold("0.3", 10) == 3 and scan.support_threshold("2", 10) == 2
    for bad in ("0", "1.5", "-1"):
        with pytest.raises(ValueError):
            scan.support_threshold(bad, 10)


def test_sites(spark):
    s = spark.createDataFrame([(1, 5), (1, 6), (1, 9), (2, 0)], "k int, site int")
    assert {tuple(r) for r in sites.extend_backwards(s, 2, ["k"]).collect()} == {(1, 5), (1, 6), (1, 7), (1, 8), (1, 9), (2, 0)}
    f = spark.createDataFrame([(3, 700, "long"), (64, 64, "one")], "start int, end int, feature string")
    got = {r.position: r.labels for r in sites.features_at(spark.createDataFrame([(2,), (3,), (64,), (700,), (701,)], "position int"), f).collect()}
    assert got == {2: "", 3: "long", 64: "long;one", 700: "long", 701: ""}
    v = spark.createDataFrame([(1, "a", 4.0), (1, "b", 4.0), (2, "a", 8.0)], "g int, c string, x double")
    t = {r.g: r for r in sites.specificity(v, "g", "c", "x").collect()}
    assert t[1].tau == 0 and t[2].tau == 1 and t[1].entropy == 1
    c = sites.classify(spark.createDataFrame([(0.6, 0.6), (0.2, 0.7), (0.1, 0.1)], "x double, y double"), "x", "y", 0.5)
    assert [r.category for r in c.collect()] == ["convergent", "divergent", "blank"]


def test_contacts_of_copies(spark):
    """Many points at few places are joined by place, and get what all pairs give."""
    few = [(1, 0.0, 0.0, 0.0), (1, 3.0, 4.0, 0.0), (1, 0.0, 0.0, 0.0), (2, 0.0, 0.0, 0.0), (3, 90.0, 0.0, 0.0), (4, None, 0.0, 0.0), (None, 0.0, 0.0, 0.0), (5, 0.0, 0.0, 8.0)]
    got = {r.id: (r.degree, round(r.proximity, 9)) for r in sites.contacts(spark.createDataFrame(few, "id int, x double, y double, z double")).collect()}
    want = {}
    for a in few:
        n, p = want.get(a[0], (0, 0.0))
        for b in few:
            if None not in a + b and a[0] != b[0] and (d := math.dist(a[1:], b[1:])) <= 8:
                n, p = n + 1, p + 1 / (1 + d)
        want[a[0]] = n, p
    assert got == {k: (n, round(p, 9)) for k, (n, p) in want.items()}
    m = 30_000  # 4.5e8 pairs by rows
    c = sites.contacts(spark.range(m).selectExpr("id", "cast(id % 2 as double) as x", "0D as y", "0D as z"))
    assert {(r.degree, round(r.proximity, 6)) for r in c.distinct().collect()} == {(m - 1, m / 2 - 1 + m / 4)}


def test_streaming(spark, tmp_path):
    spark.createDataFrame([(1, 0.5), (1, 0.25), (2, 1.0)], "branch_id int, pp double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("branch_id int, pp double").parquet(str(tmp_path / "in"))
    q = streaming_totals(stream, ["branch_id"]).writeStream.format("memory").queryName("totals").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r.branch_id: (r.n, r.total) for r in spark.table("totals").collect()} == {1: (2, 0.75), 2: (1, 1.0)}
