"""The state source, tip states and the way from files to rates."""

import gzip


import numpy as np
import pytest
from pyspark.sql import functions as F

from cladewise.functions import sequence
from cladewise.operators import combine, events as ev, expected, rates, states as st
from cladewise.sources import ancestral, fasta, newick

CODONS = ancestral.all_states()


def write_states(path, rows, columns=CODONS, opener=open, head="Node\tSite\tState"):
    with opener(path, "wt") as f:
        f.write("# posteriors\n# of nodes\n" + head + "\t" + "\t".join(f"p_{c}" for c in columns) + "\n")
        for node, site, text, p in rows:
            f.write(f"{node}\t{site}\t{text}\t" + "\t".join(f"{v:.5f}" for v in p) + "\n")


def posterior(rng, n=len(CODONS), sharp=0.05):
    p = np.round(rng.dirichlet(np.full(n, sharp)), 5)
    p[p.argmax()] += 1 - p.sum()
    return np.round(p, 5)


@pytest.fixture(scope="module")
def table(tmp_path_factory):
    rng = np.random.default_rng(5)
    rows = [(f"Node{k}", s + 1, "AAA" if (k, s) != (2, 3) else "???", posterior(rng)) for k in range(6) for s in range(9)]
    folder = tmp_path_factory.mktemp("states")
    write_states(folder / "a.state", rows)
    write_states(folder / "a.state.gz", rows, opener=gzip.open)
    return folder, rows


@pytest.mark.parametrize("name, part_bytes", [("a.state", 1 << 20), ("a.state", 97), ("a.state", 1000), ("a.state.gz", 100)])
def test_source_reads_each_line_once(spark, table, name, part_bytes):
    folder, rows = table
    got = ancestral.scan_states(spark, str(folder / name), part_bytes=part_bytes).collect()
    want = {(n, s - 1): (t == "???", [0.0] * 61 if t == "???" else p.tolist()) for n, s, t, p in rows}
    assert len(got) == len(rows) and all(want[r.node, r.site][0] == r.no_data and np.allclose(want[r.node, r.site][1], r.p) for r in got)


def test_reader_is_told_of_the_nodes(spark, table):
    folder, rows = table
    path = str(folder / "a.state")
    some = ancestral.scan_states(spark, path, ["Node1", "Node4", "none"], 500)
    assert {r.node for r in some.collect()} == {"Node1", "Node4"} and some.count() == 18
    both = some.unionByName(ancestral.scan_states(spark, path, ["Node2"]))
    assert {(r.node, r["count"]) for r in both.groupBy("node").count().collect()} == {("Node1", 9), ("Node2", 9), ("Node4", 9)}
    apart = ancestral.scan_states(spark, path)
    assert {(r.node, r["count"]) for r in apart.where("node = 'Node0'").unionByName(apart.where("node = 'Node3'")).groupBy("node").count().collect()} == {("Node0", 9), ("Node3", 9)}
    reader = ancestral.StateReader(path, 10**6, ["Node2"])
    assert sum(len(b) for p in reader.partitions() for b in reader.read(p)) == 9
    long = ancestral.state_rows(some, CODONS).groupBy("node", "site").agg(F.sum("p").alias("p")).collect()
    assert len(long) == 18 and all(abs(r.p - 1) < 1e-6 for r in long)


def test_bad_tables(spark, tmp_path):
    good = posterior(np.random.default_rng(1))
    for k, (rows, head) in enumerate([([], "Site\tNode\tState"), ([("n", 1, "AAA", good[:-1])], None), ([("n", 1, "AAA", good * 2)], None), ([("n", 1, "AAA", [float("nan"), *good[1:]])], None), ([("n", "x", "AAA", good)], None)]):
        path = tmp_path / f"{k}.state"
        write_states(path, rows, head=head or "Node\tSite\tState")
        with pytest.raises(Exception, match="state table|probabilities|malformed"):
            ancestral.scan_states(spark, str(path)).collect()


def test_audit(spark, table):
    folder, _ = table
    s = ancestral.scan_states(spark, str(folder / "a.state"))
    assert ancestral.state_problems(s, 9).count() == 0
    odd = s.where("not (node = 'Node0' and site = 2)").unionByName(s.where("node = 'Node1' and site = 0"))
    required = spark.createDataFrame([("Node5",), ("Root",), ("Root",)], "node string")
    assert {tuple(r) for r in ancestral.state_problems(odd, 9, required).collect()} == {("Node0", "sites are not 1 to n"), ("Node1", "a site is repeated"), ("Root", "missing")}


def test_tip_states_and_frequencies(spark):
    rows = [("a", "ATGTTRNNN---"), ("b", "augTARMGNA-G"), ("c", "ACNXAATGATGG"), ("d", "")]
    r = spark.createDataFrame(rows, "seq_id string, sequence string")
    got = {(x.seq_id, x.site, x.state): x.p for x in ancestral.tip_states(r).collect()}
    want, total = {}, {}
    for name, text in rows:
        for site in range(len(text) // 3):
            of = sequence.compatible_codons(text[3 * site : 3 * site + 3])
            want |= {(name, site, c): 1 / len(of) for c in of}
    assert got == want and ("b", 1, "TAA") not in got and got["a", 1, "TTA"] == 0.5
    for (_, _, c), p in want.items():
        total[c] = total.get(c, 0) + p
    freq = {x.codon: x.freq for x in ancestral.codon_frequencies(r).collect()}
    assert freq == pytest.approx({c: v / sum(total.values()) for c, v in total.items()})
    with pytest.raises(Exception, match="multiple of three"):
        ancestral.tip_states(spark.createDataFrame([("a", "ATGA")], "seq_id string, sequence string")).collect()


def test_from_files_to_rates(spark, tmp_path):
    """FASTA, Newick and a state table to omegaC, the observed counts against dense tensors."""
    rng = np.random.default_rng(8)
    tree = "((A:1,B:1)x:1,(C:1,D:1)y:1)root:0;"
    aligned = {n: "".join(rng.choice(["AAA", "AAG", "GAA", "GAR", "---"], p=[0.3, 0.2, 0.3, 0.1, 0.1]) for _ in range(12)) for n in "ABCD"}
    (tmp_path / "a.fa").write_text("".join(f">{n}\n{s}\n" for n, s in aligned.items()))
    few = ["AAA", "AAG", "GAA", "GAG"]
    inner = {(n, s): np.array([posterior(rng, 4, 0.5)[few.index(c)] if c in few else 0 for c in CODONS]) for n in ("root", "x", "y") for s in range(12)}
    inner = {k: p / p.sum() if p.sum() else np.eye(61)[0] for k, p in inner.items()}
    write_states(tmp_path / "a.state", [(n, s + 1, "AAA", p) for (n, s), p in inner.items()])
    root = newick.parse(tree)
    nodes = spark.createDataFrame([(n.name, n.branch_id, n.parent.branch_id if n.parent else None) for n in root.walk()], "name string, node int, parent int")
    named = nodes.select(F.col("name").alias("node"), F.col("node").alias("_id"))
    scanned = ancestral.scan_states(spark, str(tmp_path / "a.state"), ["root", "x", "y"])
    by_name = ancestral.observed_states(ancestral.tip_states(fasta.read_fasta(spark, str(tmp_path / "a.fa"))), ancestral.state_rows(scanned, CODONS), spark.createDataFrame([(n, n) for n in "ABCD"], "node string, seq_id string"))
    post = by_name.join(named, "node").select(F.col("_id").alias("node"), "site", "state", "p").cache()
    code = sequence.genetic_code(1)
    aa = spark.createDataFrame([(c, code[c]) for c in CODONS], "state string, grp string")
    parents = nodes.where("parent is not null").select("node", "parent")
    n_events = ev.substitution_events(st.project_states(post, aa, ["node", "site"]), parents, aa.select(F.col("grp").alias("state"), F.lit("0").alias("grp")).distinct())
    s_events = ev.substitution_events(post, parents, aa)
    ids = {r.name: r.node for r in nodes.collect()}
    pairs = spark.createDataFrame([tuple(sorted((ids[a], ids[b]))) for a, b in (("A", "C"), ("A", "D"), ("B", "C"), ("B", "D"))], "branch_id_1 int, branch_id_2 int")
    got = combine.counts(n_events, pairs, prefix="OCN", stats=("any2spe",)).join(combine.counts(s_events, pairs, prefix="OCS", stats=("any2spe",)), combine.ids(2)).collect()
    tip = {(r.seq_id, r.site, r.state): r.p for r in ancestral.tip_states(fasta.read_fasta(spark, str(tmp_path / "a.fa"))).collect()}
    P = {n: np.array([[tip.get((n, s, c), 0.0) for c in CODONS] for s in range(12)]) for n in "ABCD"} | {n: np.array([np.round(inner[n, s], 5) for s in range(12)]) for n in ("root", "x", "y")}
    up = {"A": "x", "B": "x", "C": "y", "D": "y"}
    letters = sorted(set(code[c] for c in CODONS))
    G = np.array([[code[c] == a for a in letters] for c in CODONS], float)

    def dense(node):
        """Events by site, group and derived state of both channels."""
        n = np.einsum("sa,sd->sad", P[up[node]] @ G, P[node] @ G)
        s = np.einsum("sa,sd,ag,dg->sgad", P[up[node]], P[node], G, G)
        s[:, :, range(61), range(61)] = 0
        n[:, range(len(letters)), range(len(letters))] = 0
        return n.sum(1), s.sum(2)

    for r in got:
        a, b = ({v: k for k, v in ids.items()}[r[c]] for c in combine.ids(2))
        (na, sa), (nb, sb) = dense(a), dense(b)
        assert abs(r.OCNany2spe - (na * nb).sum()) < 1e-9 and abs(r.OCSany2spe - (sa * sb).sum()) < 1e-9
    assert sum(r.OCNany2spe for r in got) > 0.5
    q = np.ones((61, 61))
    freq = {r.codon: r.freq for r in ancestral.codon_frequencies(fasta.read_fasta(spark, str(tmp_path / "a.fa"))).collect()}
    pi = np.array([freq.get(c, 0) + 1e-3 for c in CODONS])
    index = spark.createDataFrame([(c, i) for i, c in enumerate(CODONS)], "state string, i int")
    vectors = st.vectors(post.join(index, "state").select("node", "site", F.col("i").alias("state"), "p"), ["node", "site"], 61).withColumnRenamed("node", "parent")
    upv = parents.join(vectors, "parent").selectExpr("node as branch_id", "site", "p", "0.3D as t", "1.0D as rate")
    moved = expected.expected_states(upv, expected.reversible(q, pi / pi.sum()), pi / pi.sum())
    long = lambda d: d.select("branch_id", "site", F.posexplode("p").alias("i", "p")).join(index, "i").select("branch_id", "site", "state", "p")
    n_form = lambda d: st.project_states(d, aa, ["branch_id", "site"]).withColumn("grp", F.lit(0))
    number = spark.createDataFrame([(a, i) for i, a in enumerate(letters)], "grp string, g int")
    s_form = lambda d: d.join(aa, "state").join(number, "grp").select("branch_id", "site", "state", "p", F.col("g").alias("grp"))
    as_int = lambda e: e.join(number, "grp").select("branch_id", "site", F.col("g").alias("grp"), "a", "d", "pp")
    cb = rates.add_rates(rates.observed_and_expected({"N": n_events.withColumn("grp", F.lit(0)), "S": as_int(s_events)}, {"N": (n_form(long(upv)), n_form(long(moved))), "S": (s_form(long(upv)), s_form(long(moved)))}, pairs, 2, ("any2spe",)), ["any2spe"])
    out = {tuple(r[c] for c in combine.ids(2)): r for r in cb.collect()}
    assert all(abs(out[tuple(r[c] for c in combine.ids(2))].OCNany2spe - r.OCNany2spe) < 1e-9 for r in got) and all(r.omegaCany2spe >= 0 and r.ECNany2spe > 0 for r in out.values())
