"""Constrained enumeration, matches of genes, searched recodings and BLAST reports against brute force."""

import random
from itertools import combinations, product

import numpy as np
import pytest

from cladewise.functions import recoding
from cladewise.operators import combine, gene_match, recode_search as R
from cladewise.sources import ancestral, blast, newick

# constrained enumeration


def random_tree(rng, leaves):
    parts = [f"L{i}" for i in range(leaves)]
    while len(parts) > 2:
        a, b = parts.pop(rng.randrange(len(parts))), parts.pop(rng.randrange(len(parts)))
        parts.append(f"({a}:1,{b}:1)")
    return f"({parts[0]}:1,{parts[1]}:1);"


@pytest.mark.parametrize("leaves, largest, sisters", [(6, 5, True), (9, 4, False), (40, 2, True)])
def test_enumeration_counts_as_the_tree_does(spark, leaves, largest, sisters):
    root = newick.parse(random_tree(random.Random(leaves), leaves))
    nodes = spark.createDataFrame([(n.branch_id, n.parent.branch_id if n.parent else None) for n in root.walk()], "node int, parent int")
    dependent = combine.dependent_pairs(nodes, sisters=sisters).cache()
    branches = nodes.where("parent is not null").selectExpr("node as branch_id")
    clash = {tuple(r) for r in dependent.collect()}
    wanted = newick.count_independent(root, largest, exclude_sisters=sisters)
    every = sorted(r.branch_id for r in branches.collect())
    for k in range(1, largest + 1):
        got = [tuple(r) for r in combine.constrained(branches, dependent, k).collect()]
        assert len(got) == len(set(got)) == wanted[k - 1]
        if leaves < 40:
            assert set(got) == {c for c in combinations(every, k) if not any((a, b) in clash for a, b in combinations(c, 2))}


def test_enumeration_of_nothing(spark):
    none = spark.createDataFrame([], "lo int, hi int")
    few = spark.createDataFrame([(5,), (3,), (5,)], "branch_id int")
    assert {tuple(r) for r in combine.constrained(few, none, 2).collect()} == {(3, 5)}
    assert combine.constrained(few.limit(0), none, 2).count() == 0 and combine.constrained(few, none, 3).count() == 0


# genes


def plain_windows(aligned, gene):
    """The choice by comparing codons window by window."""
    options = lambda c: set(ancestral.compatible_codons(c))
    a = [options(aligned[i : i + 3]) for i in range(0, len(aligned), 3)]
    first = [(ancestral.compatible_codons(gene[i : i + 3]) or [None])[0] for i in range(0, len(gene), 3)]
    n, m, out = len(a), len(first), [-1] * len(a)
    for w in (100, 50, 10, 5, 4, 3, 2, 1):
        if not (w < m and w < n):
            continue
        open_ = [i for i in range(n) if out[i] == -1]
        free = [t for t in range(m) if t not in set(out)]
        able = set(free)
        for i in range(1, len(free)):
            if free[i] - 1 != free[i - 1]:
                able |= {t for t in range(free[i] - w, free[i]) if t >= 0}
        for k, s in enumerate(open_):
            if k and s < open_[k - 1] + max(w // 5, 1):
                continue
            if s + w > n:
                break
            for t in sorted(able):
                if t + w > m:
                    break
                if all(first[t + i] is not None and first[t + i] in a[s + i] for i in range(w)):
                    later = [x for x in out[s + w - 1 :] if x != -1]
                    if later and min(later) < t + w - 1:
                        continue
                    out[s : s + w] = range(t, t + w)
                    break
    return out


def test_gene_matches_equal_plain_windows(spark):
    rng = random.Random(4)
    codon = lambda few: rng.choice(few or ancestral.all_states())
    aligned, genes = [], []
    for k in range(7):
        few = ["AAA", "AAG", "GAA"] if k in (2, 5) else None
        gene = [codon(few) for _ in range(130 if k == 0 else 40)] + ["TAA"]
        kept = [c for c in gene if rng.random() < 0.8]
        row = []
        for c in kept:
            row += ["---"] * (rng.random() < 0.15) + ["AAN" if rng.random() < 0.05 else "ACX" if rng.random() < 0.05 else c]
        if k == 3:
            gene[5] = "GAR"
        aligned.append((f"s{k}", row))
        genes.append((f"s{k}", "".join(gene)[:9] + "---" + "".join(gene)[9:]))
    sites = max(len(r) for _, r in aligned)
    rows = [(n, "".join(r + ["---"] * (sites - len(r)))) for n, r in aligned] + [("gap", "---" * sites)]
    genes += [("gap", "ATGATG"), ("none", "ATG")]
    schema = "seq_id string, sequence string"
    got = {(r.seq_id, r.site): r.gene_site for r in gene_match.match_genes(ancestral.tip_states(spark.createDataFrame(rows, schema)), spark.createDataFrame(genes, schema), sites).collect()}
    for name, text in rows:
        want = plain_windows(text, dict(genes)[name].replace("-", ""))
        assert [got.get((name, i), -1) for i in range(sites)] == want, name
    assert sum(v >= 0 for v in got.values()) > 100
    with pytest.raises(Exception, match="multiple of three"):
        gene_match.gene_codons(spark.createDataFrame([("a", "ATGA")], schema)).collect()


# recodings


def residues(spark, letters, seed, taxa=5, sites=40):
    rng = np.random.default_rng(seed)
    share = [rng.dirichlet(np.full(len(letters), 1.0)) for _ in range(taxa)]
    rows = [(f"t{t}", s, letters[rng.choice(len(letters), p=share[t])]) for t in range(taxa) for s in range(sites) if rng.random() < 0.9]
    return rows, spark.createDataFrame(rows + [("t0", 99, "-")], "seq_id string, site int, letter string")


def plain_criterion(rows, letters, method):
    taxa = sorted({r[0] for r in rows})
    n = np.array([[sum(r[0] == t and r[2] == x for r in rows) for x in letters] for t in taxa], float)
    whole = (n.sum(0) + 1e-12) / (n.sum(0) + 1e-12).sum()
    meet = np.zeros((len(letters), len(letters)))
    for s in {r[1] for r in rows}:
        c = np.array([sum(r[1] == s and r[2] == x for r in rows) for x in letters], float)
        meet += np.outer(c, c)
    np.fill_diagonal(meet, 0)
    meet += 1e-12 * (1 - np.eye(len(letters)))
    flow = whole[:, None] * meet / meet.sum(1, keepdims=True)

    def value(groups):
        if method == "chi_squared":
            return max(sum((own[g].sum() / own.sum() - whole[g].sum()) ** 2 / whole[g].sum() for g in groups) * own.sum() for own in n)
        return sum((flow[g].sum() - flow[np.ix_(g, g)].sum()) / whole[g].sum() for g in groups)

    return value


@pytest.mark.parametrize("method", ["chi_squared", "conductance"])
def test_search_finds_the_best_partition(spark, method):
    letters = "ACDEFG"
    rows, df = residues(spark, letters, 3)
    classes, best, tried = R.search(df, letters, 3, method, starts=40, seed=5)
    value = plain_criterion(rows, letters, method)
    every = {}
    for of in product(range(3), repeat=6):
        if len(set(of)) == 3:
            groups = [[i for i in range(6) if of[i] == k] for k in range(3)]
            every[tuple(sorted("".join(letters[i] for i in g) for g in groups))] = value(groups)
    assert best == pytest.approx(min(every.values()), abs=1e-9) and every[tuple(sorted(classes))] == pytest.approx(best, abs=1e-9)
    assert classes == sorted(classes) and "".join(sorted("".join(classes))) == letters
    assert all(every[tuple(sorted(r.classes))] == pytest.approx(r.criterion, abs=1e-9) for r in tried.collect())
    assert R.search(df.repartition(7), letters, 3, method, starts=40, seed=5)[:2] == (classes, best)


def test_search_refuses(spark):
    _, df = residues(spark, "ACD", 1)
    for args in (("ACD", 1, "chi_squared"), ("ACD", 4, "chi_squared"), ("ACD", 2, "other"), ("XY", 2, "chi_squared")):
        with pytest.raises(ValueError):
            R.search(df, *args, starts=2)


def test_plane_of_recodings(spark):
    names = ["dayhoff6", "sr6", "kgb6", "sr4", "dayhoff9", "dayhoff12"]
    rows = [(n, a, g) for n in names for a, g in recoding.classes(n).items()]
    out, share = R.plane(spark.createDataFrame(rows, "scheme string, letter string, class string"))
    letters = "ACDEFGHIKLMNPQRSTVWY"
    X = np.array([[float(recoding.classes(n)[a] == recoding.classes(n)[b]) for a, b in combinations(letters, 2)] for n in sorted(names)])
    u, s, _ = np.linalg.svd(X - X.mean(0), full_matrices=False)
    got = np.array([[r.x, r.y] for r in out.orderBy("scheme").collect()])
    want = u[:, :2] * s[:2]
    want *= np.sign(want[np.abs(want).round(9).argmax(0), range(2)])
    assert np.allclose(got, want) and np.allclose(share, (s**2 / (s**2).sum())[:2])


# BLAST

REPORT = """<?xml version="1.0"?>
<BlastXML2 xmlns="http://www.ncbi.nlm.nih.gov"><BlastOutput2><report><Report><results><Results><search><Search><query-len>9</query-len><hits>
<Hit><num>1</num><description><HitDescr><id>sp|P12345.2|AA_HUMAN</id><accession>P12345.2</accession><title>first &amp; best</title></HitDescr><HitDescr><id>x</id><accession>Q99999</accession></HitDescr></description><len>5</len><hsps><Hsp><num>1</num></Hsp></hsps></Hit>
<Hit><num>2</num><description><HitDescr><id>sp|P12345.3|AA_MOUSE</id><title>same accession</title></HitDescr></description></Hit>
<Hit><num>3</num><description><HitDescr><id> Q1ABC2.1 rest</id><accession> </accession><title/></HitDescr></description></Hit>
<Hit><num>4</num><description><HitDescr><title>O00001 by title</title></HitDescr></description></Hit>
<Hit><num>5</num><id>sp|A0A001|Z</id><accession>A0A001</accession></Hit>
<Hit><num>6</num><description><HitDescr><len>3</len></HitDescr></description></Hit>
</hits></Search></search></Results></results></Report></report></BlastOutput2></BlastXML2>
"""


def test_blast_hits(spark, tmp_path):
    (tmp_path / "a.xml").write_text(REPORT)
    (tmp_path / "b.xml").write_text(REPORT.replace("P12345", "B00001"))
    (tmp_path / "c.xml").write_text(REPORT[: REPORT.index("<Hit>")] + "</hits></Search></search></Results></results></Report></report></BlastOutput2></BlastXML2>")
    rows = blast.read_hits(spark, str(tmp_path)).collect()
    got = {f: [(r.accession, r.title) for r in sorted(rows, key=lambda r: r.rank) if r.file.endswith(f)] for f in ("a.xml", "b.xml", "c.xml")}
    rest = [("Q1ABC2", "Q1ABC2.1 rest"), ("O00001", "O00001 by title"), ("A0A001", "sp|A0A001|Z")]
    assert got["a.xml"] == [("P12345", "sp|P12345.2|AA_HUMAN first & best"), *rest] and got["b.xml"][0][0] == "B00001" and got["c.xml"] == []
    (tmp_path / "bad.xml").write_text(REPORT.replace("</description><len>5", "<len>5"))
    with pytest.raises(Exception):
        blast.read_hits(spark, str(tmp_path / "bad.xml")).collect()
