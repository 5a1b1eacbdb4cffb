"""Queries over the driver's tables for site tables, trees, summaries and permutations, each with its SQL twin.

Stand-ins as in queries.py. The tree: nations (0 to 24) below regions (100 to
104) below a root (200); a nation has the sites that its suppliers' keys give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import text
from .operators import combine, epistasis, events as ev, expected, omega_null, permute, pseudocounts, ranking, rates, recode_search, scan, site_jobs, site_tables, states as st, summaries, traits
from .plans import statistics
from .plans.settled import settled
from .queries import EV, FREE, SITES, _CB, _OM, branches, cb_table, channels, events, free_pairs, query, r, rate_table, site_axis, t


def tree(spark, sf):
    n = t(spark, sf, "nation").selectExpr("cast(n_nationkey as int) as node", "cast(n_regionkey + 100 as int) as parent")
    up = n.select(F.col("parent").alias("node"), F.lit(200).alias("parent")).distinct()
    return n.unionByName(up).unionByName(spark.range(1).selectExpr("200 as node", "cast(null as int) as parent"))


def present(spark, sf):
    return t(spark, sf, "supplier").selectExpr("cast(s_nationkey as int) as leaf", "cast(s_suppkey % 97 as int) as site").distinct()


@query(f"WITH {EV} SELECT site, d, round(sum(pp), 6) AS total FROM ev GROUP BY 1, 2")
def axis_totals(spark, sf):
    return summaries.axis_sums(events(spark, sf), ("branch_id", "grp", "a")).select("site", "d", r("total"))


@query(f"WITH {EV} SELECT branch_id, d, round(sum(pp), 6) AS total FROM ev GROUP BY 1, 2")
def branch_features(spark, sf):
    own, _ = summaries.two_way(ev.project(events(spark, sf), "any2spe"), ["d"])
    return own.select("branch_id", "d", r("total"))


@query(f"WITH {EV}, s AS (SELECT branch_id, site, a, d, sum(pp) AS pp FROM ev WHERE branch_id IN (1, 6, 11) GROUP BY ALL) SELECT site, a, d, round(product(pp), 6) AS v FROM s GROUP BY ALL HAVING count(*) = 3")
def branch_products(spark, sf):
    chosen = branches(spark, sf).where("branch_id in (1, 6, 11)")
    return summaries.aggregate_branches(events(spark, sf), chosen, "product").select("site", "a", "d", r("v"))


@query(f"WITH {EV}, x AS (SELECT a, d, sum(pp) AS v FROM ev GROUP BY ALL), s AS (SELECT DISTINCT a AS s FROM ev UNION SELECT DISTINCT d FROM ev) SELECT p.s AS a, q.s AS d, round(coalesce(v, 0), 6) AS total FROM s p JOIN s q ON p.s <> q.s LEFT JOIN x ON x.a = p.s AND x.d = q.s")
def change_matrix(spark, sf):
    e = events(spark, sf)
    both = e.select("a").union(e.select("d")).distinct().select(F.lit(0).alias("grp"), F.col("a").alias("state"))
    return summaries.change_totals(e, both).select("a", "d", r("total"))


_DIST = "dist AS (SELECT x.n_nationkey AS x, y.n_nationkey AS y, CASE WHEN x.n_regionkey = y.n_regionkey THEN 2.0 ELSE 4.0 END + (x.n_nationkey * 7 + y.n_nationkey * 3) % 11 AS dist FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey)"


def distances(spark, sf):
    n = t(spark, sf, "nation").selectExpr("cast(n_nationkey as int) as x", "n_regionkey as r")
    both = n.join(F.broadcast(n.selectExpr("x as y", "r as q")), F.expr("x < y"))
    return both.selectExpr("x", "y", "cast(if(r = q, 2.0, 4.0) + (x * 7 + y * 3) % 11 as double) as dist")


@query(f"WITH {EV}, {_DIST}, b AS (SELECT branch_id, a, d, round(sum(pp), 9) AS m FROM ev GROUP BY ALL HAVING round(sum(pp), 9) >= 0.5), k AS (SELECT DISTINCT a, d FROM ev), f AS (SELECT u.a, u.d, max(dist - (0.5 + v.branch_id % 3)) AS far FROM b u JOIN b v ON u.a = v.a AND u.d = v.d AND u.branch_id < v.branch_id JOIN dist ON x = u.branch_id AND y = v.branch_id GROUP BY 1, 2) SELECT k.a, k.d, CAST(far AS DOUBLE) AS dist FROM k LEFT JOIN f ON f.a = k.a AND f.d = k.d")
def change_distances(spark, sf):
    e = events(spark, sf).groupBy("branch_id", "grp", "a", "d").agg(F.round(F.sum("pp"), 9).alias("pp"))
    lengths = branches(spark, sf).selectExpr("branch_id", "cast(0.5 + branch_id % 3 as double) as length")
    return summaries.farthest_changes(e, distances(spark, sf), lengths).select("a", "d", "dist")


@query("WITH x AS (SELECT CAST(l_partkey % 97 AS INT) AS site, CAST(l_linenumber % 4 AS INT) AS s, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT x.s AS a, y.s AS d, sum(x.n * y.n) + 1e-12 AS k FROM x JOIN x y ON x.site = y.site AND x.s <> y.s GROUP BY 1, 2) SELECT a, d, round(k / sum(k) OVER (PARTITION BY a), 9) AS q FROM k")
def transition_matrix(spark, sf):
    x = t(spark, sf, "lineitem").selectExpr("cast(l_partkey % 97 as int) as site", "cast(l_linenumber % 4 as int) as state")
    return summaries.transition_matrix(x, x.select("state")).select("a", "d", r("q", 9))


@query("SELECT s, round(n / sum(n) OVER (), 9) AS freq FROM (SELECT CAST(l_linenumber % 4 AS INT) AS s, count(*) + 1e-12 AS n FROM lineitem GROUP BY 1)")
def pooled_frequencies(spark, sf):
    x = t(spark, sf, "lineitem").selectExpr("l_suppkey as seq_id", "l_partkey as site", "cast(l_linenumber % 4 as int) as state")
    return summaries.state_frequencies(x, x.select("state"))[1].select(F.col("state").alias("s"), r("freq", 9))


@query("SELECT c_mktsegment, count(*) AS n_rows, count(c_acctbal) AS n_finite, max(c_acctbal) AS max_score, median(c_acctbal) AS median_score, count(*) FILTER (c_acctbal >= 5000 AND c_nationkey >= 10) AS n_hits FROM customer GROUP BY 1")
def run_summary(spark, sf):
    return summaries.run_summary(t(spark, sf, "customer"), ["c_mktsegment"], "c_acctbal", "c_nationkey", 5000, 10)


@query("""WITH l AS (SELECT 'o_orderstatus' AS parameter, o_orderstatus AS value, o_totalprice AS x FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority, o_totalprice FROM orders)
 SELECT parameter, value, count(*) AS n, round(avg(x), 4) AS mean, round(median(x), 4) AS median, min(x) AS least, max(x) AS most FROM l GROUP BY 1, 2""")
def parameter_summary(spark, sf):
    s = summaries.parameter_summary(t(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], ["o_totalprice"])
    return s.select("parameter", "value", "n", F.round("mean_o_totalprice", 4).alias("mean"), F.round("median_o_totalprice", 4).alias("median"), F.col("min_o_totalprice").alias("least"), F.col("max_o_totalprice").alias("most"))


@query(f"WITH {EV}, p AS (SELECT DISTINCT s_nationkey AS node, s_suppkey % 97 AS site FROM supplier), q AS (SELECT 100 + n_regionkey AS node, site FROM p JOIN nation ON node = n_nationkey), u AS (SELECT n_nationkey AS branch_id, site FROM nation JOIN p ON node = n_nationkey UNION SELECT n_nationkey, site FROM nation JOIN q ON node = 100 + n_regionkey), c AS (SELECT branch_id, count(*) AS codons FROM u GROUP BY 1), s AS (SELECT branch_id, sum(pp) AS subs FROM ev GROUP BY 1) SELECT CAST(branch_id AS INT) AS branch_id, codons, round(subs / codons, 6) AS length FROM c JOIN s USING (branch_id)")
def branch_lengths(spark, sf):
    """Substitutions per site that a nation or its region has."""
    leaves = present(spark, sf).withColumnRenamed("leaf", "node")
    nodes = tree(spark, sf)
    inner = leaves.join(nodes, "node").select(F.col("parent").alias("node"), "site").distinct()
    out = summaries.rescaled_lengths(events(spark, sf), leaves.unionByName(inner), nodes.where("node < 100"))
    return out.where("subs > 0 and codons > 0").select("branch_id", "codons", r("length"))


@query("""WITH p AS (SELECT DISTINCT s_nationkey AS leaf, CAST(s_suppkey % 97 AS INT) AS site FROM supplier), q AS (SELECT n_regionkey AS g, leaf, site FROM p JOIN nation ON leaf = n_nationkey),
 c AS (SELECT g AS node, 'c' || leaf AS clade, site FROM q UNION SELECT o.r, 's' || q.g, q.site FROM q JOIN (SELECT DISTINCT n_regionkey AS r FROM nation) o ON o.r <> q.g)
 SELECT CAST(100 + node AS INT) AS node, site FROM c GROUP BY node, site HAVING count(*) >= 2""")
def informative_sites(spark, sf):
    return st.informative_sites(tree(spark, sf), present(spark, sf))


@query("SELECT CAST(n_nationkey AS INT) AS node, CAST(CASE WHEN n_regionkey = 2 THEN 200 ELSE 100 + n_regionkey END AS INT) AS parent FROM nation UNION ALL SELECT DISTINCT CAST(100 + n_regionkey AS INT), 200 FROM nation WHERE n_regionkey <> 2")
def effective_parents(spark, sf):
    """Region 102 has no states, so its nations hang below the root."""
    return st.effective_parents(tree(spark, sf), tree(spark, sf).where("node <> 102").select("node"))


@query("WITH q AS (SELECT CAST(l_linenumber % 6 AS INT) AS a, CAST(l_suppkey % 6 AS INT) AS d, sum(l_discount) AS rate FROM lineitem WHERE l_linenumber % 6 <> l_suppkey % 6 GROUP BY 1, 2), g AS (SELECT a // 2 AS a, d // 2 AS d, sum(rate) AS rate FROM q WHERE a // 2 <> d // 2 GROUP BY 1, 2) SELECT CAST(a AS INT) AS a, CAST(d AS INT) AS d, round(rate, 6) AS rate FROM g UNION ALL SELECT CAST(a AS INT), CAST(a AS INT), round(-sum(rate), 6) FROM g GROUP BY a")
def group_rates(spark, sf):
    x = t(spark, sf, "lineitem").selectExpr("cast(l_linenumber % 6 as int) as a", "cast(l_suppkey % 6 as int) as d", "l_discount")
    q = x.where("a <> d").groupBy("a", "d").agg(F.sum("l_discount").alias("rate"))
    groups = q.selectExpr("a as state").union(q.select("d")).distinct().selectExpr("state", "cast(floor(state / 2) as int) as grp")
    return st.project_rates(q, groups).select("a", "d", F.round("rate", 6).alias("rate"))


@query("WITH w AS (SELECT x.i AS s, sum(CASE WHEN y.i <> x.i AND y.i <> 0 THEN (x.i + 1) * (y.i + 2) / 10.0 ELSE 0 END) / sum(CASE WHEN y.i <> x.i THEN (x.i + 1) * (y.i + 2) / 10.0 ELSE 0 END) AS w FROM range(4) x(i), range(4) y(i) WHERE x.i < 2 GROUP BY 1), p AS (SELECT s_nationkey AS node, l_partkey % 97 AS site, l_linenumber % 4 AS s, sum(l_extendedprice) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), k AS (SELECT node, site, s, v / sum(v) OVER (PARTITION BY node, site) AS p FROM p) SELECT CAST(node AS INT) AS node, CAST(site AS INT) AS site, round(sum(p * w), 6) AS opportunity FROM k JOIN w USING (s) GROUP BY ALL")
def scan_opportunity(spark, sf):
    """Exposure of the change from states 0 and 1 to 1, 2 and 3, as a share of all changes of each state."""
    x = t(spark, sf, "lineitem").join(t(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    p = st.shares(x.selectExpr("cast(s_nationkey as int) as node", "cast(l_partkey % 97 as int) as site", "cast(l_linenumber % 4 as int) as state", "l_extendedprice as w"), ["node", "site"], "state", "w")
    s = spark.range(4).selectExpr("cast(id as int) as a")
    q = s.join(F.broadcast(s.withColumnRenamed("a", "d")), F.expr("a <> d")).withColumn("rate", F.expr("(a + 1) * (d + 2) / 10D"))
    return scan.opportunity(p, q, [0, 1], [1, 2, 3], True).select("node", "site", r("opportunity"))


_SUBS = f"WITH {EV}, {FREE}, s AS (SELECT branch_id, round(sum(pp), 0) AS n FROM ev GROUP BY 1), c AS (SELECT b1 AS branch_id_1, b2 AS branch_id_2, list_sort([x.n, y.n]) AS p FROM free JOIN s x ON x.branch_id = b1 JOIN s y ON y.branch_id = b2), f AS (SELECT p, row_number() OVER (ORDER BY min((branch_id_1, branch_id_2))) - 1 AS pattern FROM c GROUP BY p)"


@query(f"{_SUBS} SELECT branch_id_1, branch_id_2, pattern FROM c JOIN f USING (p)")
def substitution_patterns(spark, sf):
    totals = events(spark, sf).groupBy("branch_id").agg(F.round(F.sum("pp"), 0).alias("sub"))
    cb = combine.with_branch_totals(free_pairs(spark, sf), totals, 2)
    return site_tables.substitution_patterns(cb, ["sub_1", "sub_2"], combine.ids(2), "pattern").select(*combine.ids(2), "pattern")


@query("WITH x AS (SELECT CAST(l_suppkey AS INT) AS seq_id, CAST(l_partkey AS INT) AS site, min(l_returnflag) AS f FROM lineitem GROUP BY ALL) SELECT seq_id, site, row_number() OVER (PARTITION BY seq_id ORDER BY site) AS gene_site FROM x WHERE f <> 'A'")
def gene_index(spark, sf):
    x = t(spark, sf, "lineitem").groupBy(F.col("l_suppkey").cast("int").alias("seq_id"), F.col("l_partkey").cast("int").alias("site")).agg(F.min("l_returnflag").alias("residue"))
    return site_tables.gene_index(x, "A")


@query(f"WITH {EV}, s AS (SELECT site, sum(pp) AS total, max(pp) AS top FROM ev GROUP BY 1), b AS (SELECT site, sum(pp) FILTER (branch_id = 3) AS n3, max(a) FILTER (branch_id = 3) AS a3 FROM ev GROUP BY 1) SELECT s.site, round(total, 6) AS total, round(n3, 6) AS sub_3, coalesce(a3, '') AS state_3, CASE a3 WHEN 'A' THEN 129.0 WHEN 'N' THEN 195.0 WHEN 'R' THEN 274.0 END AS hydrophobicity_3, (site * 2 + 1) % 7 AS residue_number FROM s JOIN b USING (site)")
def site_table(spark, sf):
    """Sites with totals, one branch's total and state, the state's hydrophobicity and a residue number."""
    e = events(spark, sf)
    sites = ev.site_totals(e, name="total")
    own = e.groupBy("site").agg(F.sum(F.when(F.col("branch_id") == 3, F.col("pp"))).alias("sub"))
    state = e.groupBy("branch_id", "site").agg(F.max("a").alias("state"))
    numbering = spark.range(SITES).selectExpr("cast(id as int) as position", "(id * 2 + 1) % 7 as number")
    out = site_tables.add_states(site_tables.add_site_stats(sites, own, "_3"), state, [3])
    return site_tables.add_residue_numbers(out, numbering, "site").select("site", r("total"), r("sub_3"), "state_3", "hydrophobicity_3", "residue_number")


@query(f"WITH {EV}, c AS (SELECT s_suppkey % 97 AS site, min((s_acctbal, s_suppkey)) AS m FROM supplier WHERE s_suppkey % 2 = 0 GROUP BY 1), e AS (SELECT branch_id, site, sum(pp) AS pp FROM ev GROUP BY 1, 2) SELECT branch_id, e.site, round(pp, 6) AS pp, m[1] AS x, m[2] AS y FROM e LEFT JOIN c ON c.site = e.site")
def event_coordinates(spark, sf):
    c = t(spark, sf, "supplier").where("s_suppkey % 2 = 0").selectExpr("cast(s_suppkey % 97 as int) as site", "s_acctbal as x", "s_suppkey as y", "0 as z")
    e = events(spark, sf).groupBy("branch_id", "site").agg(F.sum("pp").alias("pp"))
    return site_tables.add_coordinates(e, c).select("branch_id", "site", r("pp"), "x", "y")


@query("SELECT l_suppkey, max_by(l_orderkey * 10 + l_linenumber, (l_discount, l_quantity, l_orderkey * 10 + l_linenumber)) AS structure_id FROM lineitem GROUP BY 1")
def best_structures(spark, sf):
    x = t(spark, sf, "lineitem").withColumn("structure_id", F.expr("l_orderkey * 10 + l_linenumber"))
    return site_tables.best_structures(x, "l_suppkey", ["l_discount", "l_quantity"])


@query("WITH x AS (SELECT c_nationkey AS clade, c_custkey AS leaf, row_number() OVER (PARTITION BY c_nationkey ORDER BY length(c_name || c_mktsegment), c_custkey) - 1 AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer) SELECT clade, leaf FROM x WHERE k = n // 2")
def representative_leaves(spark, sf):
    x = t(spark, sf, "customer").selectExpr("c_nationkey as clade", "c_custkey as leaf", "concat(c_name, c_mktsegment) as sequence")
    return site_tables.representative_leaves(x.withColumn("sequence", F.regexp_replace("sequence", "-", "")))


@query(f"WITH {EV}, s AS (SELECT site, max(v) AS score FROM (SELECT site, branch_id, sum(pp) AS v FROM ev WHERE branch_id IN (2, 4) GROUP BY 1, 2) GROUP BY 1) SELECT site, round(score, 6) AS score FROM s WHERE round(score, 9) >= 0.5 ORDER BY round(score, 9) DESC, site LIMIT 10")
def lineage_sites(spark, sf):
    e = events(spark, sf).groupBy("site").agg(*[F.round(F.sum(F.when(F.col("branch_id") == b, F.col("pp"))), 9).alias(f"N_sub_{b}") for b in (2, 4)])
    return site_tables.strongest_sites(e, ["N_sub_2", "N_sub_4"], 0.5, 10).select("site", r("score"))


@query(f"WITH {EV}, v AS (SELECT branch_id, site, a, d, sum(pp) AS pp, (site * 7 + ascii(a) * 3 + ascii(d)) % 13 - 6.0 AS score FROM ev GROUP BY ALL) SELECT site, CAST(min(score) AS DOUBLE) AS score, min((score, -round(pp, 9), branch_id))[3] AS branch_id FROM v GROUP BY 1")
def variant_scores(spark, sf):
    e = events(spark, sf).groupBy("branch_id", "site", "a", "d").agg(F.round(F.sum("pp"), 9).alias("pp"))
    s = e.select("site", "a", "d").distinct().withColumn("score", F.expr("cast((site * 7 + ascii(a) * 3 + ascii(d)) % 13 - 6 as double)"))
    return site_tables.variant_scores(e, s).select("site", "score", "branch_id")


@query(f"{_CB} SELECT branch_id_1, branch_id_2, (branch_id_1 + branch_id_2) % 5 = 0 AS is_listed FROM cb")
def flagged_pairs(spark, sf):
    pairs = free_pairs(spark, sf)
    listed = pairs.where("(branch_id_1 + branch_id_2) % 5 = 0").selectExpr("branch_id_2 as branch_id_1", "branch_id_1 as branch_id_2")
    return permute.flag_combinations(pairs, listed, 2, "is_listed")


@query(f"{_CB} SELECT branch_id_1, branch_id_2, round(OCNany2spe, 6) AS OCNany2spe FROM cb WHERE (branch_id_1 * 3 + branch_id_2) % 4 <> 1")
def requested_pairs(spark, sf):
    """Rows of requested combinations: half of them are known, the others are counted now."""
    every = free_pairs(spark, sf)
    known = combine.counts(events(spark, sf), every.where("branch_id_1 % 2 = 0"), stats=("any2spe",))
    requested = every.where("(branch_id_1 * 3 + branch_id_2) % 4 <> 1")
    return permute.known_rows(requested, known, 2, lambda c: combine.counts(events(spark, sf), c, stats=("any2spe",))).select(*combine.ids(2), r("OCNany2spe"))


@query("SELECT n_name AS name, 'tree' AS only_in FROM nation WHERE n_nationkey % 4 = 1 UNION ALL SELECT r_name, 'alignment' FROM region")
def taxon_differences(spark, sf):
    n = t(spark, sf, "nation")
    alignment = n.where("n_nationkey % 4 <> 1").selectExpr("n_name as name").union(t(spark, sf, "region").selectExpr("r_name as name"))
    return permute.taxon_differences(n.selectExpr("n_name as name"), alignment)


@query("SELECT CAST(n_nationkey AS INT) AS branch_id FROM nation WHERE n_nationkey % 5 <> 0 AND n_regionkey IN (1, 3)")
def other_branches(spark, sf):
    n = t(spark, sf, "nation").selectExpr("cast(n_nationkey as int) as branch_id", "n_regionkey as r")
    return permute.other_branches(n, n.where("branch_id % 5 = 0"), n.where("r in (1, 3)"))


@query("SELECT CAST(n_nationkey AS INT) AS branch_id, 2 AS depth FROM nation WHERE n_nationkey = 7 UNION ALL SELECT CAST(100 + n_regionkey AS INT), 1 FROM nation WHERE n_nationkey = 7")
def lineage_path(spark, sf):
    return permute.lineage_path(st.ancestors(tree(spark, sf)), 200, 7)


_PERM = f"""WITH {EV}, m AS (SELECT site, d, branch_id, sum(pp) AS m FROM ev GROUP BY ALL), rd AS (SELECT i AS round, n_nationkey AS branch_id FROM range(1, 9) r(i), nation WHERE (n_nationkey * 7 + i * 3) % 5 = 0), ob AS (SELECT n_nationkey AS branch_id FROM nation WHERE n_nationkey % 6 = 1),
 ex AS (SELECT n_nationkey AS branch_id, 1.0 + n_nationkey % 3 AS l FROM nation), al AS (SELECT sum(l) AS al FROM ex), w AS (SELECT site, d, sum(m) AS ax FROM m GROUP BY 1, 2),
 s AS (SELECT 0 AS round, branch_id FROM ob UNION ALL SELECT round, branch_id FROM rd), lt AS (SELECT round, sum(l) AS lt FROM s JOIN ex USING (branch_id) GROUP BY 1),
 x AS (SELECT site, d, round, sum(m) AS xt FROM m JOIN s USING (branch_id) GROUP BY ALL), j AS (SELECT w.site, w.d, lt.round, coalesce(xt, 0) AS xt, greatest(ax - coalesce(xt, 0), 0) AS xo, ax / al AS pooled, lt, al - lt AS lo FROM w CROSS JOIN lt CROSS JOIN al LEFT JOIN x ON x.site = w.site AND x.d = w.d AND x.round = lt.round),
 l AS (SELECT site, d, round, round(CASE WHEN xt * lo > xo * lt THEN greatest(0, 2 * (CASE WHEN xt > 0 THEN xt * ln(xt / (lt * pooled)) ELSE 0 END + CASE WHEN xo > 0 THEN xo * ln(xo / (lo * pooled)) ELSE 0 END)) ELSE 0 END, 9) AS lrt FROM j),
 mx AS (SELECT round, max(lrt) AS m FROM l WHERE round > 0 GROUP BY 1)"""


def scan_mass(spark, sf):
    e = events(spark, sf).groupBy("site", "d", "branch_id").agg(F.sum("pp").alias("m"))
    return e.select("site", F.lit("any2spe").alias("match"), F.lit("any").alias("key_a"), F.col("d").alias("key_d"), "branch_id", "m")


@query(f"{_PERM} SELECT o.site, o.d, round(o.lrt, 6) AS lrt, round((1 + (SELECT count(*) FROM l WHERE l.round > 0 AND l.site = o.site AND l.d = o.d AND l.lrt >= o.lrt)) / 9.0, 6) AS empirical, round((1 + (SELECT count(*) FROM mx WHERE mx.m >= o.lrt)) / 9.0, 6) AS empirical_max FROM l o WHERE o.round = 0")
def scan_calibration(spark, sf):
    """Scan statistics of a foreground against those of eight others, by candidate and by each round's largest."""
    n = t(spark, sf, "nation").selectExpr("cast(n_nationkey as int) as branch_id")
    exposure = n.selectExpr("branch_id", "cast(1.0 + branch_id % 3 as double) as exposure")
    rounds = spark.range(1, 9).selectExpr("id as round").join(F.broadcast(n), F.expr("(branch_id * 7 + round * 3) % 5 = 0"))
    mass = scan_mass(spark, sf)
    observed = permute.observed_enrichment(mass, n.where("branch_id % 6 = 1"), exposure)
    out = permute.calibrated(observed, permute.permuted_enrichment(mass, rounds, exposure), 8)
    return out.select("site", F.col("key_d").alias("d"), r("lrt"), r("empirical"), r("empirical_max"))


@query(f"{_CB}, rd AS (SELECT i AS round, n_nationkey AS b FROM range(1, 13) r(i), nation WHERE (n_nationkey * 5 + i * 7) % 4 = 0) SELECT x.round, count(*) AS n, round(median(OCNany2spe), 6) AS median, round(sum(OCNany2spe), 6) AS total FROM cb JOIN rd x ON x.b = branch_id_1 JOIN rd y ON y.b = branch_id_2 AND y.round = x.round GROUP BY 1")
def clade_permutation(spark, sf):
    """Medians and totals of the combinations within each of twelve permuted foregrounds."""
    n = t(spark, sf, "nation").selectExpr("cast(n_nationkey as int) as branch_id")
    rounds = spark.range(1, 13).selectExpr("id as round").join(F.broadcast(n), F.expr("(branch_id * 5 + round * 7) % 4 = 0"))
    return permute.permuted_summary(cb_table(spark, sf), 2, rounds, "OCNany2spe").select("round", "n", r("median"), r("total"))


@query(f"{_CB} SELECT branch_id_1, branch_id_2, round(OCNany2any, 6) AS OCNany2any, round(OCNany2any - OCNany2spe, 6) AS OCNany2dif FROM cb")
def requested_columns(spark, sf):
    """Only the base statistics that the requested ones need are counted, and only the requested ones stay."""
    stats = "any2dif, any2any"
    cb = combine.counts(events(spark, sf), free_pairs(spark, sf), stats=tuple(statistics.required_base(stats)))
    cb = combine.add_some_differences(cb, "OCN", statistics.required_differences(stats))
    return statistics.ordered(statistics.requested(cb, stats)).select(*combine.ids(2), r("OCNany2any"), r("OCNany2dif"))


@query(f"WITH {EV}, {FREE}, w AS (SELECT branch_id, site, sum(pp) / sum(sum(pp)) OVER (PARTITION BY branch_id) AS w FROM ev GROUP BY 1, 2) SELECT x.branch_id AS branch_id_1, y.branch_id AS branch_id_2, round(sum(x.w * y.w), 9) AS expected FROM w x JOIN w y ON x.site = y.site JOIN free ON b1 = x.branch_id AND b2 = y.branch_id GROUP BY ALL")
def urn_overlap(spark, sf):
    """Expected overlap of urns with one draw each, where both laws give the weights themselves."""
    bs = events(spark, sf).groupBy("branch_id", "site").agg(F.sum("pp").alias("sub"))
    one = branches(spark, sf).withColumn("n", F.lit(1.0))
    return expected.urn_overlap(expected.site_weights(bs, SITES).select("branch_id", "site", "weight"), one, free_pairs(spark, sf), "wallenius").select(*combine.ids(2), r("expected", 9))


_RATES = f"""WITH {EV}, n AS (SELECT site, sum(pp) AS v FROM ev GROUP BY 1), s AS (SELECT site, sum(pp) AS v FROM ev WHERE grp2 = 0 GROUP BY 1), p AS (SELECT DISTINCT s_nationkey AS branch_id, CAST(s_suppkey % 97 AS INT) AS site FROM supplier)"""


@query(f"{_RATES} SELECT branch_id, site, round((coalesce(n.v, 0) + coalesce(s.v, 0)) / sum(coalesce(n.v, 0) + coalesce(s.v, 0)) OVER (PARTITION BY branch_id), 9) AS weight FROM p LEFT JOIN n USING (site) LEFT JOIN s USING (site)")
def pooled_site_rates(spark, sf):
    totals = {"N": ev.site_totals(events(spark, sf)), "S": ev.site_totals(events(spark, sf, "l_linenumber % 2").where("grp = 0"))}
    have = present(spark, sf).withColumnRenamed("leaf", "branch_id")
    return summaries.site_rates(totals, "pool", SITES, have)["N"].select("branch_id", "site", r("weight", 9))


@query("SELECT c_custkey, nullif(CAST(regexp_extract(c_name, '([0-9]+)$', 1) AS BIGINT), 0) AS number, regexp_extract(c_name, '^([A-Za-z]+)', 1) AS species, substring(upper(c_mktsegment), 1 + greatest(least(c_custkey % 5 + 1 - 1 - 2, length(c_mktsegment) - 4), 0), 4) AS around FROM customer")
def text_fields(spark, sf):
    c = t(spark, sf, "customer")
    number = text.residue_number(F.regexp_extract("c_name", "([0-9]+)$", 1))
    at = (F.col("c_custkey") % 5 + 1).cast("int")
    return c.select("c_custkey", number.alias("number"), text.species_label(F.col("c_name"), "^([A-Za-z]+)", 1).alias("species"), text.window_at(F.col("c_mktsegment"), at, 4)["text"].alias("around"))


@query(f"""{_OM}, k AS (SELECT sum(ocn_any2any) AS a, sum(ocn_any2spe) AS b FROM ra) SELECT branch_id_1, branch_id_2, round((ocn_any2spe + 2 * b / a) / (ecn_any2spe + 2 * b / a), 6) AS dNC, round((ocs_any2spe + 2 * b / a) / (ecs_any2spe + 2 * b / a), 6) AS dSC,
 round(((ocn_any2spe + 2 * b / a) / (ecn_any2spe + 2 * b / a)) / ((ocs_any2spe + 2 * b / a) / (ecs_any2spe + 2 * b / a)), 6) AS omegaC FROM ra, k""")
def smoothed_rates(spark, sf):
    """Rates of any2spe with a pseudocount of 2 spread over the statistics by their share of all events."""
    cb = settled(rate_table(spark, sf))
    alphas = pseudocounts.stat_alphas(pseudocounts.total_masses(cb, "OCN", "any2any,any2spe"), "any2spe", 2.0)
    out = pseudocounts.add_smoothed_rates(cb, alphas)
    return out.select(*combine.ids(2), *[F.round(f"{c}any2spe_smoothed", 6).alias(c) for c in ("dNC", "dSC", "omegaC")])


@query("WITH p AS (SELECT n_nationkey AS i, n_nationkey + 5 AS j FROM nation WHERE n_nationkey + 5 < 25 UNION ALL SELECT n_nationkey, n_nationkey + 1 FROM nation WHERE n_nationkey % 2 = 0 AND n_nationkey + 1 < 25), u AS (SELECT DISTINCT list_sort(list_distinct([x.i, x.j, y.i, y.j])) AS m FROM p x JOIN p y ON (x.i, x.j) < (y.i, y.j)) SELECT CAST(m[1] AS INT) AS branch_id_1, CAST(m[2] AS INT) AS branch_id_2, CAST(m[3] AS INT) AS branch_id_3 FROM u WHERE len(m) = 3")
def member_unions(spark, sf):
    """Triples that are unions of two of the pairs (i, i + 5) and, for even i, (i, i + 1)."""
    b = branches(spark, sf).select(F.col("branch_id").cast("int").alias("i"))
    two = b.where("i + 5 < 25").selectExpr("array(i, i + 5) as members").union(b.where("i % 2 = 0 and i + 1 < 25").selectExpr("array(i, i + 1)"))
    return combine.unions(two, 3)


@query()
def omega_pvalues(spark, sf):
    """p and q of each pair's omegaC against rounds in which every branch of the tree draws its substitutions anew (seeded; no SQL twin)."""
    observed, vectors = channels(spark, sf)
    observed = {c: settled(e) for c, e in observed.items()}
    cb = rates.add_rates(rates.observed_and_expected(observed, vectors, free_pairs(spark, sf), 2, ("any2spe",)), ["any2spe"])
    weights = {c: expected.site_weights(e.groupBy("branch_id", "site").agg(F.sum("pp").alias("sub")), SITES).select("branch_id", "site", "weight") for c, e in observed.items()}
    draws = {c: omega_null.feature_draws(e, ("any2spe",)) for c, e in observed.items()}
    out = omega_null.omega_pvalues(cb, weights, draws, 2, ("any2spe",), (20, 60), 2)
    return out.select(*combine.ids(2), r("omegaCany2spe"), r("pomegaCany2spe"), r("qomegaCany2spe"))


@query()
def auto_recoding(spark, sf):
    """The best of 64 searches for four classes of ten letters by conductance (tested against all partitions; no SQL twin)."""
    x = t(spark, sf, "lineitem").selectExpr("l_suppkey as seq_id", "l_partkey as site", "substr('ABCDEFGHIJ', 1 + cast((l_partkey * 3 + l_linenumber * l_linenumber + l_quantity) % 10 as int), 1) as letter")
    found, criterion, _ = recode_search.search(x, "ABCDEFGHIJ", 4, "conductance", starts=64)
    return spark.createDataFrame([(k, c, round(criterion, 9)) for k, c in enumerate(found)], "class int, letters string, criterion double")


@query()
def contact_tilts(spark, sf):
    """Tilts of every branch's sites, chosen jointly in three bins of root distance (tested against a NumPy loop; no SQL twin)."""
    p = t(spark, sf, "part").selectExpr("cast(p_partkey % 97 as int) as site", "p_retailprice", "p_size").groupBy("site").agg(F.avg("p_retailprice").alias("price"), F.avg("p_size").alias("size"))
    z = ranking.z_scores(ranking.z_scores(p, "price", out="z0"), "size", out="z1")
    features = z.select("site", F.posexplode(F.array("z0", "z1")).alias("feature", "value"))
    counts = events(spark, sf).groupBy("branch_id", "site").agg(F.round(F.sum("pp"), 9).alias("n"))
    depths = t(spark, sf, "nation").selectExpr("n_nationkey as branch_id", "cast(n_nationkey * 7 % 11 as double) as depth")
    binned = settled(epistasis.depth_groups(epistasis.branch_scores(counts, features), depths, 3))
    out = epistasis.tilts(binned, ["depth_bin"], epistasis.prepare(binned, ["depth_bin"], joint=True))
    return out.select("branch_id", "site", "depth_bin", r("score"), r("tilt"))


@query()
def staged_pvalues(spark, sf):
    """Empirical p of each pair's number of shared sites, permuted 20 times and, where that leaves it coarse, 60 times."""
    sub = events(spark, sf).groupBy("branch_id", "site").agg(F.sum("pp").alias("sub"))
    have = sub.where("sub >= 0.3").select("branch_id", "site")
    weights = settled(expected.site_weights(sub, SITES).select("branch_id", "site", "weight"))
    draws = settled(have.groupBy("branch_id").agg(F.count(F.lit(1)).cast("double").alias("n")))
    x, y = have.withColumnRenamed("branch_id", "branch_id_1"), have.withColumnRenamed("branch_id", "branch_id_2")
    pairs = free_pairs(spark, sf)
    observed = pairs.join(x.join(y, "site").groupBy(*combine.ids(2)).agg(F.count(F.lit(1)).alias("overlap")), combine.ids(2), "left").fillna(0, ["overlap"])
    return rates.staged_p(observed, combine.ids(2), "overlap", lambda rows, a, b: expected.permuted_overlaps(weights, draws, rows, b, first=a), (20, 60), 1)


@query(f"WITH {EV}, {FREE}, w AS (SELECT branch_id, site, sum(pp) / sum(sum(pp)) OVER (PARTITION BY branch_id) AS w FROM ev GROUP BY 1, 2), k AS (SELECT b1, b2, sum(x.w * y.w) AS k FROM free JOIN w x ON x.branch_id = b1 JOIN w y ON y.branch_id = b2 AND y.site = x.site GROUP BY 1, 2), n AS (SELECT branch_id, d, sum(pp) AS n FROM ev GROUP BY 1, 2), o AS (SELECT b1, b2, sum(x.v * y.v) AS o FROM free JOIN (SELECT branch_id, site, d, sum(pp) AS v FROM ev GROUP BY ALL) x ON x.branch_id = b1 JOIN (SELECT branch_id, site, d, sum(pp) AS v FROM ev GROUP BY ALL) y ON y.branch_id = b2 AND y.site = x.site AND y.d = x.d GROUP BY 1, 2) SELECT b1 AS branch_id_1, b2 AS branch_id_2, round(o, 6) AS OCNany2spe, round(k * (SELECT sum(x.n * y.n) FROM n x JOIN n y ON x.d = y.d WHERE x.branch_id = b1 AND y.branch_id = b2), 6) AS ECNany2spe FROM k JOIN o USING (b1, b2)")
def urn_counts(spark, sf):
    """Observed counts, and those that urns of each derived state let expect."""
    e = events(spark, sf)
    weights = expected.site_weights(e.groupBy("branch_id", "site").agg(F.sum("pp").alias("sub")), SITES).select("branch_id", "site", "weight")
    urns = {"N": expected.urn_projections(weights, omega_null.feature_draws(e, ("any2spe",)))}
    cb = rates.observed_and_expected({"N": e}, {}, free_pairs(spark, sf), 2, ("any2spe",), urns=urns)
    return cb.select(*combine.ids(2), r("OCNany2spe"), r("ECNany2spe"))


_SET = f"""WITH {EV}, v AS (SELECT site, d AS channel, branch_id, sum(pp) AS v FROM ev GROUP BY ALL), w AS (SELECT site, channel, coalesce(sum(v) FILTER (branch_id = 1), 0) AS v1, coalesce(sum(v) FILTER (branch_id = 2), 0) AS v2, coalesce(max(v) FILTER (branch_id NOT IN (1, 2)), 0) AS va FROM v GROUP BY 1, 2),
 j AS (SELECT *, (round(v1, 9) >= 0.3 OR round(v2, 9) >= 0.3) AND NOT round(va, 9) >= 0.7 AS ok, greatest(CASE WHEN round(v1, 9) >= 0.3 THEN v1 ELSE 0 END, CASE WHEN round(v2, 9) >= 0.3 THEN v2 ELSE 0 END) AS p FROM w), g AS (SELECT site, max(v1) AS p1, max(v2) AS p2, bool_or(ok) AS e, max(CASE WHEN ok THEN p ELSE 0 END) AS pe, max(va) AS pa, bool_or(round(va, 9) >= 0.7) AS o FROM j GROUP BY 1)"""


@query(f"{_SET} SELECT CAST(i AS INT) AS site, round(least(coalesce(p1, 0), 1), 6) AS n_1, round(least(coalesce(p2, 0), 1), 6) AS n_2, coalesce(e, false) AS selected, round(coalesce(pe, 0), 6) AS probability, round(coalesce(pa, 0), 6) AS other FROM range(97) x(i) LEFT JOIN g ON site = i")
def set_columns(spark, sf):
    """Columns of the expression (1|2)-A in each derived state; the named branches count from 0.3, the others from 0.7."""
    e = events(spark, sf).groupBy("branch_id", "site", "grp", "a", "d").agg(F.sum("pp").alias("pp"))
    scaled = e.withColumn("pp", F.when(F.col("branch_id").isin(1, 2), F.col("pp")).otherwise(F.col("pp") * 3 / 7))  # one threshold for both
    out = site_jobs.set_columns(site_axis(spark), scaled, site_jobs.parse_mode("set,spe,(1|2)-A"), 0.3 - 1e-9)
    return out.select("site", F.round("N_set_branch_1_prob", 6).alias("n_1"), F.round("N_set_branch_2_prob", 6).alias("n_2"), F.col("N_set_expr").alias("selected"), F.round("N_set_expr_prob", 6).alias("probability"), F.round(F.col("N_set_other_prob") * 7 / 3, 6).alias("other"))


@query(f"{_CB}, rd AS (SELECT i AS round, n_nationkey AS b FROM range(1, 13) r(i), nation WHERE (n_nationkey * 5 + i * 7) % 4 = 0), x AS (SELECT x.round, median(OCNany2spe) AS median FROM cb JOIN rd x ON x.b = branch_id_1 JOIN rd y ON y.b = branch_id_2 AND y.round = x.round GROUP BY 1), o AS (SELECT median(OCNany2spe) AS m FROM cb WHERE branch_id_1 % 3 = 0 AND branch_id_2 % 3 = 0) SELECT count(*) AS n, count(*) FILTER (median >= m) AS as_large, round(count(*) FILTER (median >= m) / CAST(count(*) AS DOUBLE), 6) AS p, round(median(median), 6) AS median FROM x, o")
def clade_permutation_p(spark, sf):
    """Where the foreground's median lies among those of twelve permuted foregrounds."""
    n = t(spark, sf, "nation").selectExpr("cast(n_nationkey as int) as branch_id")
    rounds = spark.range(1, 13).selectExpr("id as round").join(F.broadcast(n), F.expr("(branch_id * 5 + round * 7) % 4 = 0"))
    cb = settled(cb_table(spark, sf))
    observed = permute.permuted_summary(cb, 2, n.where("branch_id % 3 = 0").select(F.lit(0).alias("round"), "branch_id"), "OCNany2spe").first()["median"]
    out = permute.summary_p(permute.permuted_summary(cb, 2, rounds, "OCNany2spe"), observed)
    return out.select("n", "as_large", r("p"), r("median"))


@query("SELECT CAST(i AS BIGINT) AS codon_site_alignment, CAST(i + 1 AS BIGINT) AS codon_site_alignment_1based, coalesce(k - 1, -1) AS site, coalesce(k, 0) AS site_1based, CASE WHEN k IS NULL THEN 'N' ELSE 'Y' END AS is_retained FROM range(97) x(i) LEFT JOIN (SELECT site, row_number() OVER (ORDER BY site) AS k FROM (SELECT DISTINCT s_suppkey % 97 AS site FROM supplier)) y ON y.site = i")
def site_index_map(spark, sf):
    kept = ev.reindex_sites(t(spark, sf, "supplier").selectExpr("s_suppkey % 97 as site"))
    return site_jobs.site_index_map(kept, SITES)


@query("SELECT n_nationkey AS branch_id, CASE WHEN n_nationkey % 3 = 0 THEN 'Y' ELSE 'N' END AS is_fg_a, CASE WHEN n_nationkey % 4 = 1 THEN 'Y' ELSE 'N' END AS is_mg_a, CASE WHEN n_nationkey % 5 = 2 THEN 'Y' ELSE 'N' END AS is_fg_b, 'N' AS is_mg_b FROM nation")
def branch_flags(spark, sf):
    b = branches(spark, sf)
    of = lambda trait, rule: b.where(rule).select(F.lit(trait).alias("trait"), "branch_id")
    return traits.label_branches(b, of("a", "branch_id % 3 = 0").union(of("b", "branch_id % 5 = 2")), of("a", "branch_id % 4 = 1"))
