"""Queries over the driver's tables, each with its SQL twin.

The tables stand in for a tree and its events: branches are nations, sites are
part keys modulo 97, ancestral states are return flags, derived states line
numbers modulo 4, the posterior is the discount, and nations of one region
depend on each other. Doubles are rounded, as sums differ in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import numeric, sequence
from .operators import combine, events as ev, expected, full_scan, ranking, rates, scan, sites, states as st, traits
from .plans import cutoff, set_expression
from .plans.settled import settled
from .sources import ancestral

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
SITES = 97


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str, grp: str = "0") -> DataFrame:
    """The event table: grp 0 for all (N-like), or a line number's parity (S-like, with grp='l_linenumber % 2')."""
    s = t(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    x = t(spark, sf, "lineitem").where("l_discount > 0").join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    return x.selectExpr("s_nationkey as branch_id", "cast(l_partkey % 97 as int) as site", f"cast({grp} as int) as grp", "l_returnflag as a", "cast(l_linenumber % 4 as string) as d", "l_discount as pp")


def branches(spark, sf):
    return t(spark, sf, "nation").selectExpr("n_nationkey as branch_id")


def site_axis(spark):
    return spark.range(SITES).selectExpr("cast(id as int) as site")


def dependent(spark, sf):
    n = t(spark, sf, "nation")
    x, y = n.selectExpr("n_nationkey as lo", "n_regionkey as r"), n.selectExpr("n_nationkey as hi", "n_regionkey as r")
    return x.join(y, "r").where("lo < hi").select("lo", "hi")


def free_pairs(spark, sf):
    return combine.independent(combine.pairs(branches(spark, sf)), dependent(spark, sf), 2)


def r(c: str, n: int = 6):
    return F.round(numeric.no_nan(F.col(c)), n).alias(c)


EV = """ev AS (SELECT s_nationkey AS branch_id, CAST(l_partkey % 97 AS INT) AS site, 0 AS grp, CAST(l_linenumber % 2 AS INT) AS grp2,
 l_returnflag AS a, CAST(l_linenumber % 4 AS VARCHAR) AS d, l_discount AS pp FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_discount > 0)"""
FREE = """free AS (SELECT x.n_nationkey AS b1, y.n_nationkey AS b2 FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey AND x.n_regionkey <> y.n_regionkey)"""


def _proj(name: str, keys: str, grp: str = "grp") -> str:
    return f"{name} AS (SELECT branch_id, site, {grp} AS g{', ' + keys if keys else ''}, sum(pp) AS v FROM ev GROUP BY ALL)"


def _pairs(name: str, proj: str, keys: str, column: str) -> str:
    on = "".join(f" AND x.{k.strip()} = y.{k.strip()}" for k in keys.split(",") if k.strip())
    return f"{name} AS (SELECT x.branch_id AS b1, y.branch_id AS b2, x.site, sum(x.v * y.v) AS {column} FROM {proj} x JOIN {proj} y ON x.site = y.site AND x.g = y.g AND x.branch_id < y.branch_id{on} JOIN free ON b1 = x.branch_id AND b2 = y.branch_id GROUP BY ALL)"


KEYS = {"any2any": "", "spe2any": "a", "any2spe": "d", "spe2spe": "a, d"}
ALL_PAIRS = ",\n".join([EV, FREE] + [_proj(f"p_{s}", k) for s, k in KEYS.items()] + [_pairs(f"c_{s}", f"p_{s}", k, s) for s, k in KEYS.items()])


@query(f"WITH {EV} SELECT n_nationkey AS branch_id, round(coalesce(sum(pp), 0), 6) AS sub FROM nation LEFT JOIN ev ON n_nationkey = branch_id GROUP BY 1")
def b_table(spark, sf):
    return ev.branch_totals(events(spark, sf), branches(spark, sf)).select("branch_id", r("sub"))


@query(f"WITH {EV} SELECT CAST(i AS INT) AS site, round(coalesce(sum(pp), 0), 6) AS sub FROM range(97) x(i) LEFT JOIN ev ON i = site GROUP BY 1")
def s_table(spark, sf):
    return ev.site_totals(events(spark, sf), site_axis(spark)).select("site", r("sub"))


@query(f"WITH {EV} SELECT n_nationkey AS branch_id, CAST(i AS INT) AS site, round(coalesce(sum(pp), 0), 6) AS sub FROM nation CROSS JOIN range(97) x(i) LEFT JOIN ev ON i = site AND n_nationkey = branch_id GROUP BY 1, 2")
def bs_table(spark, sf):
    return ev.branch_site_totals(events(spark, sf), branches(spark, sf), site_axis(spark)).select("branch_id", "site", r("sub"))


def _projection(stat):
    def run(spark, sf):
        return ev.project(events(spark, sf), stat).select("branch_id", "site", *ev.FEATURES[stat], r("v"))

    run.__name__ = f"projection_{stat}"
    keys = ", ".join(ev.FEATURES[stat])
    query(f"WITH {EV} SELECT branch_id, site, {keys}, round(sum(pp), 6) AS v FROM ev GROUP BY ALL")(run)


for _s in ev.FEATURES:
    _projection(_s)


@query(f"WITH {EV} SELECT grp, a, d, CAST(GROUPING(grp, a, d) AS BIGINT) AS level, round(sum(pp), 6) AS total FROM ev GROUP BY GROUPING SETS ((grp, a, d), (grp, a), (grp, d))")
def group_state_totals(spark, sf):
    return ev.group_state_totals(events(spark, sf)).select("grp", "a", "d", F.col("level").cast("long").alias("level"), r("total"))


@query(f"WITH {EV}, k AS (SELECT *, row_number() OVER (PARTITION BY branch_id, site ORDER BY pp DESC, a, d) AS rn FROM (SELECT branch_id, site, a, d, sum(pp) AS pp FROM ev GROUP BY ALL) WHERE pp >= 0.5) SELECT branch_id, string_agg(a || (site + 1) || d, ',' ORDER BY site) AS changes FROM k WHERE rn = 1 GROUP BY 1")
def sitewise_changes(spark, sf):
    e = events(spark, sf).groupBy("branch_id", "site", "a", "d").agg(numeric.exact_sum(F.col("pp")).alias("pp"))
    return ev.sitewise_changes(e)


@query(f"WITH {FREE} SELECT b1 AS branch_id_1, b2 AS branch_id_2 FROM free")
def independent_pairs(spark, sf):
    return free_pairs(spark, sf)


@query(f"WITH {FREE} SELECT x.b1 AS branch_id_1, x.b2 AS branch_id_2, y.b2 AS branch_id_3 FROM free x JOIN free y ON y.b1 = x.b2 JOIN free z ON z.b1 = x.b1 AND z.b2 = y.b2")
def constrained_triples(spark, sf):
    """All triples of independent branches, grown without ever forming a dependent one."""
    return combine.constrained(branches(spark, sf), dependent(spark, sf), 3)


_CB = f"""WITH {ALL_PAIRS}, cb AS (SELECT b1 AS branch_id_1, b2 AS branch_id_2, {', '.join(f'coalesce({s}, 0) AS OCN{s}' for s in KEYS)} FROM free
 {' '.join(f'LEFT JOIN (SELECT b1, b2, sum({s}) AS {s} FROM c_{s} GROUP BY ALL) t_{s} USING (b1, b2)' for s in KEYS)})"""


def cb_table(spark, sf):
    return combine.counts(events(spark, sf), free_pairs(spark, sf))


@query(f"{_CB} SELECT branch_id_1, branch_id_2, {', '.join(f'round(OCN{s}, 6) AS OCN{s}' for s in KEYS)} FROM cb")
def cb_pairs(spark, sf):
    return cb_table(spark, sf).select(*combine.ids(2), *[r(f"OCN{s}") for s in ev.FEATURES])


#: A tree of 140 branches and an alignment of 971 sites: branches are part keys modulo 140, of which those equal modulo 14
#: depend on each other, and sites are order keys modulo 971.
_BIG = """be AS (SELECT CAST(l_partkey % 140 AS INT) AS branch_id, CAST(l_orderkey % 971 AS INT) AS site, l_returnflag AS a, CAST(l_linenumber % 4 AS VARCHAR) AS d, l_discount AS pp FROM lineitem WHERE l_discount > 0)"""


@query(f"""WITH {_BIG}, pr AS (SELECT DISTINCT x.branch_id AS b1, y.branch_id AS b2 FROM (SELECT DISTINCT branch_id FROM be) x, (SELECT DISTINCT branch_id FROM be) y WHERE x.branch_id < y.branch_id AND x.branch_id % 14 <> y.branch_id % 14),
 {', '.join(f"b_{s} AS (SELECT branch_id, site{', ' + k if k else ''}, sum(pp) AS v FROM be GROUP BY ALL), c_{s} AS (SELECT x.branch_id AS b1, y.branch_id AS b2, sum(x.v * y.v) AS v FROM b_{s} x JOIN b_{s} y ON x.site = y.site AND x.branch_id < y.branch_id{''.join(f' AND x.{f} = y.{f}' for f in k.split(', ') if f)} GROUP BY 1, 2)" for s, k in KEYS.items())}
 SELECT pr.b1 AS branch_id_1, pr.b2 AS branch_id_2, {', '.join(f'round(coalesce(c_{s}.v, 0), 6) AS OCN{s}' for s in KEYS)} FROM pr {' '.join(f'LEFT JOIN c_{s} ON c_{s}.b1 = pr.b1 AND c_{s}.b2 = pr.b2' for s in KEYS)}""")
def whole_search(spark, sf):
    """Counts of all four statistics for every independent pair of 140 branches over 971 sites: the size of a whole search."""
    e = t(spark, sf, "lineitem").where("l_discount > 0").selectExpr("cast(l_partkey % 140 as int) as branch_id", "cast(l_orderkey % 971 as int) as site", "0 as grp", "l_returnflag as a", "cast(l_linenumber % 4 as string) as d", "l_discount as pp")
    b = e.select("branch_id").distinct()
    x, y = b.selectExpr("branch_id as lo", "branch_id % 14 as r"), b.selectExpr("branch_id as hi", "branch_id % 14 as r")
    pairs = combine.constrained(b, x.join(y, "r").where("lo < hi").select("lo", "hi"), 2)
    return combine.counts(e, pairs).select(*combine.ids(2), *[r(f"OCN{s}") for s in ev.FEATURES])


@query(f"{_CB} SELECT branch_id_1, branch_id_2, round(OCNany2any - OCNany2spe, 6) AS OCNany2dif, round(OCNspe2any - OCNspe2spe, 6) AS OCNspe2dif, round(OCNany2any - OCNspe2any, 6) AS OCNdif2any, round(OCNany2spe - OCNspe2spe, 6) AS OCNdif2spe FROM cb")
def dif_stats(spark, sf):
    return combine.add_differences(cb_table(spark, sf), "OCN").select(*combine.ids(2), *[r(f"OCN{s}") for s in ("any2dif", "spe2dif", "dif2any", "dif2spe")])


@query(f"{_CB} SELECT branch_id_1, branch_id_2, round(OCNany2spe, 6) AS OCNany2spe FROM cb ORDER BY OCNany2spe DESC, 1, 2 LIMIT 20")
def top_convergent_pairs(spark, sf):
    p = combine.counts(events(spark, sf), free_pairs(spark, sf), stats=("any2spe",))
    return ranking.top_rows(p, [F.desc("OCNany2spe"), F.asc("branch_id_1"), F.asc("branch_id_2")], 20).select(*combine.ids(2), r("OCNany2spe"))


@query(f"WITH {ALL_PAIRS} SELECT b1 AS branch_id_1, b2 AS branch_id_2, site, round(any2spe, 6) AS OCNany2spe FROM c_any2spe")
def cbs_pairs(spark, sf):
    keys = (*combine.ids(2), "site")
    return combine.counts(events(spark, sf), free_pairs(spark, sf), stats=("any2spe",), by=keys).select(*keys, r("OCNany2spe"))


@query(f"WITH {ALL_PAIRS} SELECT site, round(sum(any2spe), 6) AS OCNany2spe, round((SELECT sum(spe2spe) FROM c_spe2spe z WHERE z.site = c_any2spe.site), 6) AS OCNspe2spe FROM c_any2spe GROUP BY site")
def cs_sites(spark, sf):
    return combine.counts(events(spark, sf), free_pairs(spark, sf), stats=("any2spe", "spe2spe"), by=("site",)).select("site", r("OCNany2spe"), r("OCNspe2spe"))


@query(f"""WITH {EV}, {_proj('p', 'd')}, tri AS (SELECT x.n_nationkey b1, y.n_nationkey b2, z.n_nationkey b3 FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey AND x.n_regionkey <> y.n_regionkey JOIN nation z ON y.n_nationkey < z.n_nationkey AND z.n_regionkey <> x.n_regionkey AND z.n_regionkey <> y.n_regionkey),
 v AS (SELECT b1, b2, b3, sum(x.v * y.v * z.v) AS v FROM tri JOIN p x ON x.branch_id = b1 JOIN p y ON y.branch_id = b2 AND y.site = x.site AND y.d = x.d JOIN p z ON z.branch_id = b3 AND z.site = x.site AND z.d = x.d GROUP BY ALL)
 SELECT b1 AS branch_id_1, b2 AS branch_id_2, b3 AS branch_id_3, round(coalesce(v, 0), 6) AS OCNany2spe FROM tri LEFT JOIN v USING (b1, b2, b3)""")
def cb_triples(spark, sf):
    """All independent triples."""
    three = combine.expand(free_pairs(spark, sf), 2, dependent(spark, sf))
    return combine.counts(events(spark, sf), three, 3, stats=("any2spe",)).select(*combine.ids(3), r("OCNany2spe"))


_Q = f"{_CB}, q AS (SELECT branch_id_1, branch_id_2 FROM cb WHERE OCNany2spe >= 60 AND OCNspe2spe >= 10)"


@query(f"""{_Q}, u AS (SELECT branch_id_1 x, branch_id_2 y FROM q UNION ALL SELECT branch_id_2, branch_id_1 FROM q), tri AS (SELECT DISTINCT list_sort([u.x, u.y, w.y]) m FROM u JOIN u w ON u.x = w.x AND u.y < w.y)
 SELECT m[1] AS branch_id_1, m[2] AS branch_id_2, m[3] AS branch_id_3 FROM tri WHERE (SELECT count(DISTINCT n_regionkey) FROM nation WHERE n_nationkey IN (m[1], m[2], m[3])) = 3""")
def apriori_triples(spark, sf):
    passed = cutoff.qualified(cb_table(spark, sf), "OCNany2spe,60|OCN(spe2spe),10")
    return combine.expand(passed, 2, dependent(spark, sf))


@query(f"{_Q} SELECT branch_id_1, branch_id_2 FROM q")
def cutoff_filter(spark, sf):
    return cutoff.qualified(cb_table(spark, sf), "OCNany2spe,60|OCNspe2spe,10").select(*combine.ids(2))


_W = f"""{_CB}, tot AS (SELECT branch_id, sum(pp) AS n FROM ev GROUP BY 1), w AS (SELECT branch_id, site, sum(pp) / sum(sum(pp)) OVER (PARTITION BY branch_id) AS w FROM ev GROUP BY 1, 2),
 e AS (SELECT x.branch_id AS branch_id_1, y.branch_id AS branch_id_2, n1.n * n2.n * sum(x.w * y.w) AS ec FROM w x JOIN w y ON x.site = y.site AND x.branch_id < y.branch_id JOIN tot n1 ON n1.branch_id = x.branch_id JOIN tot n2 ON n2.branch_id = y.branch_id JOIN free ON b1 = x.branch_id AND b2 = y.branch_id GROUP BY x.branch_id, y.branch_id, n1.n, n2.n)"""


def expected_pairs(spark, sf):
    e = events(spark, sf)
    bs = e.groupBy("branch_id", "site").agg(F.sum("pp").alias("sub"))
    return expected.urn_expectation(expected.site_weights(bs, SITES), ev.branch_totals(e), free_pairs(spark, sf))


@query(f"WITH {EV}, x AS (SELECT branch_id, site, sum(pp) AS s FROM ev GROUP BY 1, 2) SELECT branch_id, site, round((s + 0.5) / (sum(s) OVER (PARTITION BY branch_id) + 48.5), 9) AS weight FROM x")
def asrv_weights(spark, sf):
    bs = events(spark, sf).groupBy("branch_id", "site").agg(F.sum("pp").alias("sub"))
    return expected.site_weights(bs, SITES, 0.5).select("branch_id", "site", r("weight", 9))


@query(f"{_W} SELECT branch_id_1, branch_id_2, round(ec, 6) AS expected FROM e")
def urn_expected(spark, sf):
    return expected_pairs(spark, sf).select(*combine.ids(2), r("expected"))


#: A tree of nations below regions: a node's posterior at a site are shares of its lineitem prices by state (line number
#: modulo 4, 'codons' 0 and 1 of one group, 2 and 3 of another). Branch lengths are 0.1, 0.2 or 0.3; all changes are alike.
_POST = """post AS (SELECT node, site, s, w / sum(w) OVER (PARTITION BY node, site) AS p FROM (SELECT CAST(s_nationkey + k * (100 + n_regionkey - s_nationkey) AS INT) AS node, CAST(l_partkey % 97 AS INT) AS site, CAST(l_linenumber % 4 AS INT) AS s, sum(l_extendedprice) AS w
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey, (VALUES (0), (1)) v(k) GROUP BY ALL)),
 own AS (SELECT n_nationkey AS branch_id, 100 + n_regionkey AS parent, exp(-4.0 / 3 * (0.1 * (1 + n_nationkey % 3))) AS x FROM nation),
 up AS (SELECT branch_id, site, s, p FROM own JOIN post ON parent = node), down AS (SELECT branch_id, site, s, p FROM own JOIN post ON branch_id = node),
 moved AS (SELECT branch_id, site, i AS s, 0.25 + (coalesce(p, 0) - 0.25) * x AS p FROM (SELECT DISTINCT branch_id, site, x FROM up JOIN own USING (branch_id)) g CROSS JOIN range(4) r(i) LEFT JOIN (SELECT branch_id, site, s AS i, p FROM up) u USING (branch_id, site, i))"""
_AA = "SELECT branch_id, site, 0 AS g, s // 2 AS s, sum(p) AS p FROM {} GROUP BY ALL"
_SYN = "SELECT branch_id, site, s // 2 AS g, s, p FROM {}"


def _channel(name: str, child: str, form: str) -> str:
    ev_ = f"e_{name} AS (SELECT a.branch_id, a.site, a.g, a.s AS a, d.s AS d, a.p * d.p AS pp FROM ({form.format('up')}) a JOIN ({form.format(child)}) d ON a.branch_id = d.branch_id AND a.site = d.site AND a.g = d.g AND a.s <> d.s)"
    proj = [f"p_{name}_{s} AS (SELECT branch_id, site, g{', ' + k if k else ''}, sum(pp) AS v FROM e_{name} GROUP BY ALL)" for s, k in (("any2any", ""), ("any2spe", "d"))]
    return ",\n".join([ev_, *proj, *[_pairs(f"c_{name}_{s}", f"p_{name}_{s}", k, s) for s, k in (("any2any", ""), ("any2spe", "d"))]])


_OM = f"""WITH {FREE}, {_POST},
{_channel("ocn", "down", _AA)}, {_channel("ocs", "down", _SYN)}, {_channel("ecn", "moved", _AA)}, {_channel("ecs", "moved", _SYN)},
 ra AS (SELECT b1 AS branch_id_1, b2 AS branch_id_2, {", ".join(f"coalesce({c}_{s}, 0) AS {c}_{s}" for c in ("ocn", "ocs", "ecn", "ecs") for s in ("any2any", "any2spe"))} FROM free
 {" ".join(f"LEFT JOIN (SELECT b1, b2, sum({s}) AS {c}_{s} FROM c_{c}_{s} GROUP BY ALL) USING (b1, b2)" for c in ("ocn", "ocs", "ecn", "ecs") for s in ("any2any", "any2spe"))})"""


def channels(spark, sf):
    """Observed events and expected projections of the N (between groups) and S (within a group) channel."""
    x = t(spark, sf, "lineitem").join(t(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = t(spark, sf, "nation")
    w = x.selectExpr("s_nationkey", "cast(l_partkey % 97 as int) as site", "cast(l_linenumber % 4 as int) as state", "l_extendedprice").groupBy("s_nationkey", "site", "state").agg(F.sum("l_extendedprice").alias("w"))
    w = w.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.explode(F.array(F.col("s_nationkey").cast("int"), (F.col("n_regionkey") + 100).cast("int"))).alias("node"), "site", "state", "w")
    post = settled(st.shares(w, ["node", "site"], "state", "w"))  # read by both channels, as parents and as children
    groups = spark.range(4).selectExpr("cast(id as int) as state", "cast(floor(id / 2) as int) as grp")
    aa = st.project_states(post, groups, ["node", "site"])
    parents = n.selectExpr("cast(n_nationkey as int) as node", "cast(n_regionkey + 100 as int) as parent")
    own_groups = groups.select(F.col("grp").alias("state"), F.lit(0).alias("grp")).distinct()
    observed = {"N": ev.substitution_events(aa, parents, own_groups), "S": ev.substitution_events(post, parents, groups)}
    vectors = st.vectors(post, ["node", "site"], 4).withColumnRenamed("node", "parent")
    up = parents.join(vectors, "parent").selectExpr("node as branch_id", "site", "p", "0.1D * (1 + node % 3) as t", "1.0D as rate")
    q = expected.reversible(np.ones((4, 4)), np.full(4, 0.25))
    long = lambda df: df.select("branch_id", "site", F.posexplode("p").alias("state", "p"))
    above, moved = long(up), long(expected.expected_states(up, q, np.full(4, 0.25)))
    n_form = lambda df: st.project_states(df, groups, ["branch_id", "site"]).withColumn("grp", F.lit(0))
    s_form = lambda df: df.join(F.broadcast(groups), "state")
    return observed, {"N": (n_form(above), n_form(moved)), "S": (s_form(above), s_form(moved))}


STATS = ("any2any", "any2spe")


def rate_table(spark, sf, stats=STATS):
    """From posteriors to omegaC: observed and expected counts of both channels for every independent pair, and their rates."""
    return rates.add_rates(rates.observed_and_expected(*channels(spark, sf), free_pairs(spark, sf), 2, stats), list(stats))


@query(f"{_OM} SELECT branch_id_1, branch_id_2, {', '.join(f'round({c}_{s}, 6) AS {c.upper()}{s}' for c in ('ocn', 'ocs', 'ecn', 'ecs') for s in ('any2any', 'any2spe'))} FROM ra")
def observed_expected(spark, sf):
    """Counts of both channels, observed and expected, from posteriors of a tree."""
    cb = rates.observed_and_expected(*channels(spark, sf), free_pairs(spark, sf), 2, STATS)
    return cb.select(*combine.ids(2), *[r(f"{c}{s}") for c in ("OCN", "OCS", "ECN", "ECS") for s in STATS])


@query(f"{_OM} SELECT branch_id_1, branch_id_2, {', '.join(f'round(ocn_{s} / ecn_{s}, 6) AS dNC{s}, round(ocs_{s} / ecs_{s}, 6) AS dSC{s}, round((ocn_{s} / ecn_{s}) / (ocs_{s} / ecs_{s}), 6) AS omegaC{s}' for s in ('any2any', 'any2spe'))} FROM ra")
def omega_rates(spark, sf):
    return rate_table(spark, sf).select(*combine.ids(2), *[r(f"{c}{s}") for s in STATS for c in ("dNC", "dSC", "omegaC")])


_RK = "(rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0)"


@query(f"{_OM}, rr AS (SELECT branch_id_1, branch_id_2, ocn_any2spe / ecn_any2spe AS dn, CASE (branch_id_1 * 25 + branch_id_2) % 7 WHEN 0 THEN 'Infinity'::DOUBLE WHEN 1 THEN NULL ELSE ocs_any2spe / ecs_any2spe END AS ds FROM ra), rd AS (SELECT * FROM rr WHERE isfinite(ds)), k AS (SELECT *, {_RK.format('round(ds, 6)')} AS rk, count(*) OVER () AS n FROM rd), s AS (SELECT list(round(dn, 6) ORDER BY round(dn, 6)) AS l FROM rd), p AS (SELECT *, (n - 1) * (rk - 0.5) / n AS pos FROM k) SELECT branch_id_1, branch_id_2, round(greatest(round(ds, 6), l[CAST(floor(pos) AS BIGINT) + 1] + (l[CAST(ceil(pos) AS BIGINT) + 1] - l[CAST(floor(pos) AS BIGINT) + 1]) * (pos - floor(pos))), 9) AS dSCany2spe FROM p, s UNION ALL SELECT branch_id_1, branch_id_2, ds FROM rr WHERE ds IS NULL OR isinf(ds)")
def quantile_calibration(spark, sf):
    """A seventh of the synonymous rates is made infinite, another NaN: those neither count nor change."""
    cb = rate_table(spark, sf, ("any2spe",)).withColumns({c: F.round(c, 6) for c in ("dNCany2spe", "dSCany2spe")})
    odd = F.pmod(F.col("branch_id_1") * 25 + F.col("branch_id_2"), F.lit(7))
    cb = cb.withColumn("dSCany2spe", F.when(odd == 0, float("inf")).when(odd == 1, float("nan")).otherwise(F.col("dSCany2spe")))
    return rates.calibrate(cb, ["any2spe"]).select(*combine.ids(2), r("dSCany2spe", 9))


@query(f"{_CB} SELECT branch_id_1, branch_id_2, round(OCNany2spe / nullif(OCNany2any - OCNany2spe, 0), 6) AS OCNCoD FROM cb")
def convergence_divergence(spark, sf):
    return rates.add_convergence_divergence(combine.add_differences(cb_table(spark, sf), "OCN")).select(*combine.ids(2), r("OCNCoD"))


@query(f"{_CB} SELECT branch_id_1, branch_id_2, round(OCNany2spe - OCNany2any * (SELECT sum(OCNany2any * OCNany2spe) / sum(OCNany2any * OCNany2any) FROM cb), 5) AS residual FROM cb")
def linreg_residual(spark, sf):
    return rates.regression_residual(cb_table(spark, sf), "OCNany2any", "OCNany2spe", "residual").select(*combine.ids(2), r("residual", 5))


@query(f"SELECT l_orderkey, l_linenumber, round({_RK.format('l_discount')} / count(*) OVER (), 9) AS quantile FROM lineitem")
def rank_quantile(spark, sf):
    return ranking.rank_quantile(t(spark, sf, "lineitem"), "l_discount").select("l_orderkey", "l_linenumber", r("quantile", 9))


_BH = "SELECT {k}o_orderkey, round(least(1, min(raw) OVER ({p}ORDER BY p DESC ROWS UNBOUNDED PRECEDING)), 9) AS q FROM (SELECT *, p * count(*) OVER ({q}) / rank AS raw FROM (SELECT {k}o_orderkey, o_totalprice / 600000 AS p, row_number() OVER ({p}ORDER BY o_totalprice, o_orderkey) AS rank FROM orders))"


@query(_BH.format(k="", p="", q=""))
def bh_qvalues(spark, sf):
    o = t(spark, sf, "orders").withColumn("p", F.col("o_totalprice") / 600000)
    return ranking.bh_qvalues(o, "p").select("o_orderkey", r("q", 9))


@query(_BH.format(k="o_orderstatus, ", p="PARTITION BY o_orderstatus ", q="PARTITION BY o_orderstatus"))
def bh_qvalues_grouped(spark, sf):
    o = t(spark, sf, "orders").withColumn("p", F.col("o_totalprice") / 600000)
    return ranking.bh_qvalues(o, "p", ["o_orderstatus"]).select("o_orderstatus", "o_orderkey", r("q", 9))


@query("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER (PARTITION BY p_size)) / nullif(stddev_pop(p_retailprice) OVER (PARTITION BY p_size), 0), 6) AS z FROM part")
def zscore(spark, sf):
    return ranking.z_scores(t(spark, sf, "part"), "p_retailprice", ["p_size"]).select("p_partkey", r("z"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1")
def representative_row(spark, sf):
    return ranking.first_rows(t(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders WHERE o_orderstatus IN ('F', 'O')) WHERE k <= CASE o_orderstatus WHEN 'F' THEN 15 ELSE 16 END")
def balanced_top(spark, sf):
    """Of an odd total the second kind gets the row more."""
    o = t(spark, sf, "orders").where("o_orderstatus in ('F', 'O')")
    return ranking.balanced_top(o, "o_orderstatus", ("F", "O"), ("o_totalprice", "o_totalprice"), F.asc("o_orderkey"), 31).select("o_orderkey", "o_orderstatus")


@query("SELECT n_nationkey AS branch_id, ntile(4) OVER (ORDER BY n_name) AS bin FROM nation")
def depth_bins(spark, sf):
    return ranking.equal_bins(t(spark, sf, "nation"), [F.col("n_name")], 4).selectExpr("n_nationkey as branch_id", "bin")


@query("SELECT trait, lineage, n_name AS name FROM nation JOIN (VALUES ('t1', '1', 'NATION_1.*'), ('t1', '2', '.*_7|NATION_24'), ('t2', '1', 'NATION')) p(trait, lineage, pattern) ON regexp_full_match(n_name, pattern)")
def regex_foreground(spark, sf):
    p = spark.createDataFrame([("t1", "1", "NATION_1.*"), ("t1", "2", ".*_7|NATION_24"), ("t2", "1", "NATION")], "trait string, lineage string, pattern string")
    return traits.foreground_leaves(t(spark, sf, "nation").selectExpr("n_name as name"), p)


@query(f"WITH {FREE} SELECT b1 AS branch_id_1, b2 AS branch_id_2, CAST(b1 % 3 = 0 AS INT) + CAST(b2 % 3 = 0 AS INT) AS branch_num_fg, b1 % 3 = 0 AND b2 % 3 = 0 AS is_fg, b1 % 3 = 1 AND b2 % 3 = 1 AS is_mg, (b1 % 3 = 0 AND b2 % 3 = 1) OR (b1 % 3 = 1 AND b2 % 3 = 0) AS is_mf FROM free")
def fg_labels(spark, sf):
    b = branches(spark, sf)
    out = traits.label_combinations(free_pairs(spark, sf), 2, b.where("branch_id % 3 = 0"), b.where("branch_id % 3 = 1"))
    return out.select(*combine.ids(2), "branch_num_fg", "is_fg", "is_mg", "is_mf")


@query(f"""{_CB}, f AS (SELECT *, branch_id_1 % 3 = 0 AND branch_id_2 % 3 = 0 AS fg, OCNany2spe >= 60 AS ok FROM cb) SELECT count(*) AS num_all, count(*) FILTER (ok) AS num_qualified_all, count(*) FILTER (fg) AS num_is_fg, count(*) FILTER (fg AND ok) AS num_qualified_is_fg,
 round((count(*) FILTER (fg AND ok) / CAST(nullif(count(*) FILTER (ok), 0) AS DOUBLE)) / nullif(count(*) FILTER (fg) / CAST(count(*) AS DOUBLE), 0), 6) AS enrichment_is_fg, round(median(OCNany2spe), 6) AS median_all, round(sum(OCNany2spe), 4) AS total_all, round(median(OCNany2spe) FILTER (fg), 6) AS median_fg, round(sum(OCNany2spe) FILTER (fg), 4) AS total_fg FROM f""")
def cb_stats(spark, sf):
    cb = traits.label_combinations(cb_table(spark, sf), 2, branches(spark, sf).where("branch_id % 3 = 0"))
    s = traits.summarise(cb, ["OCNany2spe"], cutoff.predicate("OCNany2spe,60", cb.columns), ["is_fg"])
    named = [F.round(f"{k}_OCNany2spe_{a}", n).alias(f"{k}_{b}") for k, n in (("median", 6), ("total", 4)) for a, b in (("all", "all"), ("is_fg", "fg"))]
    return s.select("num_all", "num_qualified_all", "num_is_fg", "num_qualified_is_fg", r("enrichment_is_fg"), *named)


FG = "fg AS (SELECT * FROM ev WHERE branch_id % 5 = 0)"


def foreground(spark, sf):
    return events(spark, sf).where("branch_id % 5 = 0")


@query(f"""WITH {EV}, {FG} SELECT site, 'any2spe' AS match, 'any' AS key_a, d AS key_d, string_agg(DISTINCT a, ',' ORDER BY a) AS from_states, d AS to_states, round(sum(pp), 6) AS mass FROM fg GROUP BY site, d
 UNION ALL SELECT site, 'spe2dif', a, 'dif', a, string_agg(DISTINCT d, ',' ORDER BY d), round(sum(pp), 6) FROM fg GROUP BY site, a HAVING count(DISTINCT d) >= 2""")
def scan_candidates(spark, sf):
    c = scan.all_candidates(foreground(spark, sf), ("any2spe", "spe2dif"))
    return c.select("site", "match", "key_a", "key_d", F.array_join("from_states", ",").alias("from_states"), F.array_join("to_states", ",").alias("to_states"), r("mass"))


@query(f"""WITH {EV}, {FG}, m AS (SELECT site, d, branch_id, round(sum(pp), 9) AS m FROM fg GROUP BY ALL) SELECT site, 'any' AS key_a, d AS key_d, count(*) AS units, string_agg(branch_id, ',' ORDER BY branch_id) AS unit_ids, round(avg(m), 6) AS mean_mass FROM m WHERE m >= 0.2 GROUP BY site, d HAVING count(*) >= 2""")
def scan_support(spark, sf):
    e = foreground(spark, sf).groupBy("branch_id", "site", "a", "d").agg(F.round(F.sum("pp"), 9).alias("pp"))
    units = branches(spark, sf).where("branch_id % 5 = 0").selectExpr("branch_id as unit", "branch_id")
    s = scan.support(scan.candidates(e, "any2spe"), e, units, 0.2 - 1e-9, scan.support_threshold("0.4", 5))
    return s.select("site", "key_a", "key_d", "units", F.array_join("unit_ids", ",").alias("unit_ids"), r("mean_mass"))


@query(f"""WITH {EV}, {FG}, c AS (SELECT DISTINCT site, d FROM fg), x AS (SELECT site, d, sum(pp) FILTER (branch_id % 5 = 0) AS xt, coalesce(sum(pp) FILTER (branch_id % 5 <> 0), 0) AS xo FROM ev JOIN c USING (site, d) GROUP BY ALL), l AS (SELECT *, xt / 15.0 AS rt, xo / 60.0 AS ro, (xt + xo) / 75.0 AS p FROM x)
 SELECT site, d AS key_d, round(xt, 6) AS xt, round(xo, 6) AS xo, round(CASE WHEN ro > 0 THEN rt / ro END, 9) AS ratio, round(CASE WHEN rt > ro THEN greatest(0, 2 * (xt * ln(xt / (15.0 * p)) + CASE WHEN xo > 0 THEN xo * ln(xo / (60.0 * p)) ELSE 0 END)) ELSE 0 END, 6) AS lrt FROM l""")
def scan_rates(spark, sf):
    e = events(spark, sf)
    b = branches(spark, sf).select("branch_id", (F.col("branch_id") % 5 == 0).alias("target"), F.lit(3.0).alias("exposure"))
    out = scan.enrichment(scan.candidates(foreground(spark, sf), "any2spe"), e, b)
    ratio = F.when(F.abs("ratio") < float("inf"), F.col("ratio"))
    return out.select("site", "key_d", r("xt"), r("xo"), F.round(ratio, 9).alias("ratio"), r("lrt"))


@query()
def scan_pvalues(spark, sf):
    """Half the chi-squared tail of scan_rates (SQL has no erfc), with q-values within each state."""
    out = scan.with_p(scan_rates(spark, sf)).withColumn("p", F.round("p", 12))
    return ranking.bh_qvalues(out, "p", ["key_d"]).select("site", "key_d", "p", r("q", 9))


#: Candidates of all nine classes in events x (by round, site, a, d), with the states that their closed sides allow.
def _classes(source: str) -> str:
    out = []
    for x in ("any", "spe", "dif"):
        for y in ("any", "spe", "dif"):
            keys = [s for s, side in (("a", x), ("d", y)) if side == "spe"]
            key = {s: {"any": "'any'", "spe": s, "dif": f"string_agg(DISTINCT {s}, ',' ORDER BY {s})"}[side] for s, side in (("a", x), ("d", y))}
            states = {s: "NULL" if side == "any" else f"list(DISTINCT {s})" for s, side in (("a", x), ("d", y))}
            having = " AND ".join(f"count(DISTINCT {s}) >= 2" for s, side in (("a", x), ("d", y)) if side == "dif")
            out.append(f"SELECT round, site, '{x}2{y}' AS match, {key['a']} AS key_a, {key['d']} AS key_d, {states['a']} AS as_, {states['d']} AS ds_ FROM {source} GROUP BY {', '.join(['round', 'site', *keys])}{' HAVING ' + having if having else ''}")
    return " UNION ALL ".join(out)


_FULL = f"""WITH {EV}, e AS (SELECT branch_id, site, a, d, round(sum(pp), 9) AS pp FROM ev GROUP BY ALL),
 un AS (SELECT 0 AS round, n_nationkey % 4 AS unit, n_nationkey AS branch_id FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT i, n_nationkey % 4, n_nationkey FROM range(1, 9) r(i), nation WHERE (n_nationkey * 7 + i * 3) % 5 < 2),
 ex AS (SELECT n_nationkey AS branch_id, 1.0 + n_nationkey % 3 AS l FROM nation), need AS (SELECT round, CAST(ceil(0.5 * count(DISTINCT unit)) AS INT) AS least FROM un GROUP BY 1),
 seen AS (SELECT round, site, a, d FROM e JOIN un USING (branch_id)), c AS ({_classes("seen")}),
 m AS (SELECT c.round, c.site, match, key_a, key_d, e.branch_id, sum(pp) AS m FROM c JOIN e ON e.site = c.site AND (as_ IS NULL OR list_contains(as_, e.a)) AND (ds_ IS NULL OR list_contains(ds_, e.d)) GROUP BY ALL),
 su AS (SELECT round, site, match, key_a, key_d, count(*) AS units FROM (SELECT m.round, site, match, key_a, key_d, unit, max(m) AS m FROM m JOIN un USING (round, branch_id) GROUP BY ALL HAVING max(m) >= 0.3 - 1e-9) GROUP BY ALL),
 x AS (SELECT m.round, site, match, key_a, key_d, coalesce(sum(m) FILTER (unit IS NOT NULL), 0) AS xt, coalesce(sum(m) FILTER (unit IS NULL), 0) AS xo FROM m LEFT JOIN un USING (round, branch_id) GROUP BY ALL),
 le AS (SELECT round, sum(l) AS lt, (SELECT sum(l) FROM ex) - sum(l) AS lo FROM un JOIN ex USING (branch_id) GROUP BY 1),
 s AS (SELECT *, (xt + xo) / (lt + lo) AS p FROM su JOIN x USING (round, site, match, key_a, key_d) JOIN le USING (round) JOIN need USING (round) WHERE units >= least),
 l AS (SELECT *, CASE WHEN xt * lo > xo * lt THEN greatest(0, 2 * (CASE WHEN xt > 0 THEN xt * ln(xt / (lt * p)) ELSE 0 END + CASE WHEN xo > 0 THEN xo * ln(xo / (lo * p)) ELSE 0 END)) ELSE 0 END AS lrt FROM s),
 mx AS (SELECT i AS round, coalesce((SELECT max(round(lrt, 9)) FROM l WHERE l.round = i), 0) AS m FROM range(1, 9) r(i))"""


def round_units(spark, sf):
    """Foregrounds of a scan: the observed one is round 0; units are nations modulo 4."""
    n = t(spark, sf, "nation").selectExpr("cast(n_nationkey as int) as branch_id")
    of = lambda rounds, rule: rounds.join(F.broadcast(n), F.expr(rule)).selectExpr("round", "branch_id % 4 as unit", "branch_id")
    return of(spark.range(1).selectExpr("id as round"), "branch_id % 3 = 1").unionByName(of(spark.range(1, 9).selectExpr("id as round"), "(branch_id * 7 + round * 3) % 5 < 2"))


def scanned_rounds(spark, sf):
    e = events(spark, sf).groupBy("branch_id", "site", "a", "d").agg(F.round(F.sum("pp"), 9).alias("pp"))
    exposure = branches(spark, sf).selectExpr("branch_id", "cast(1.0 + branch_id % 3 as double) as exposure")
    return full_scan.full_scan(e, round_units(spark, sf), exposure, min_pp=0.3 - 1e-9, support="0.5")


@query(f"{_FULL} SELECT round, site, match, key_a, key_d, units, round(xt, 6) AS xt, round(xo, 6) AS xo, round(lrt, 6) AS lrt FROM l")
def full_scan_rounds(spark, sf):
    """Candidates of all nine classes, their support and rates, for the observed foreground and eight others."""
    return scanned_rounds(spark, sf).select("round", *scan.KEYS, "units", r("xt"), r("xo"), r("lrt"))


@query(f"{_FULL} SELECT site, match, key_a, key_d, round(lrt, 6) AS lrt, round((1 + (SELECT count(*) FROM l p WHERE p.round > 0 AND p.site = o.site AND p.match = o.match AND p.key_a = o.key_a AND p.key_d = o.key_d AND round(p.lrt, 9) >= round(o.lrt, 9))) / 9.0, 6) AS empirical, round((1 + (SELECT count(*) FROM mx WHERE m >= round(o.lrt, 9))) / 9.0, 6) AS empirical_max FROM l o WHERE round = 0")
def full_scan_calibration(spark, sf):
    """The observed scan against eight whole scans of other foregrounds: by candidate, and by each round's largest statistic."""
    return full_scan.calibrated_scan(scanned_rounds(spark, sf), 8).select(*scan.KEYS, r("lrt"), r("empirical"), r("empirical_max"))


_ST = "st AS (SELECT CAST(l_partkey % 97 AS INT) AS site, l_returnflag || l_linenumber AS state, l_quantity AS p FROM lineitem)"


def states(spark, sf):
    return t(spark, sf, "lineitem").selectExpr("cast(l_partkey % 97 as int) as site", "concat(l_returnflag, l_linenumber) as state", "l_quantity as p")


@query(f"WITH {_ST}, m AS (SELECT site, state, sum(p) AS m FROM st GROUP BY ALL), q AS (SELECT *, m / sum(m) OVER (PARTITION BY site) AS q FROM m), v AS (SELECT CAST(l_partkey % 97 AS INT) AS site, count(DISTINCT l_suppkey) AS valid_tips FROM lineitem GROUP BY 1) SELECT site, arg_min(state, (-q, state)) AS major, round(max(q), 6) AS share, round(-sum(q * ln(q)) / ln(61), 6) AS entropy, round(sum(m), 4) AS mass, any_value(valid_tips) AS valid_tips FROM q JOIN v USING (site) GROUP BY site")
def conservation_entropy(spark, sf):
    """Entropy over the log of 61 states, of which not all are seen."""
    tips = t(spark, sf, "lineitem").selectExpr("cast(l_partkey % 97 as int) as site", "l_suppkey as tip", "concat(l_returnflag, l_linenumber) as state", "l_quantity as p")
    return scan.conservation(tips, 61).select("site", "major", r("share"), r("entropy"), r("mass", 4), "valid_tips")


@query(f"WITH {_ST}, m AS (SELECT site, state, sum(p) AS x FROM st GROUP BY ALL), q AS (SELECT *, sum(x) OVER (PARTITION BY site) AS s, max(x) OVER (PARTITION BY site) AS mx FROM m) SELECT site, round(((SELECT count(DISTINCT state) FROM st) - max(s) / max(mx)) / ((SELECT count(DISTINCT state) FROM st) - 1), 6) AS tau, round(-sum(x / s * log2(x / s)), 6) AS entropy, round(max(mx) / max(s), 6) AS tsi FROM q GROUP BY site")
def tau_specificity(spark, sf):
    return sites.specificity(states(spark, sf), "site", "state", "p").select("site", r("tau"), r("entropy"), r("tsi"))


@query(f"WITH {_ST}, m AS (SELECT site, state, round(sum(p), 6) AS p FROM st GROUP BY ALL) SELECT site, arg_min(state, (-p, state)) AS state, max(p) AS p FROM m GROUP BY site")
def state_argmax(spark, sf):
    m = states(spark, sf).groupBy("site", "state").agg(F.round(F.sum("p"), 6).alias("p"))
    return ev.most_likely_states(m, ["site"])


@query(f"""WITH {EV}, x AS (SELECT site, branch_id, sum(pp) AS v FROM ev WHERE branch_id IN (1, 2, 3) GROUP BY ALL), o AS (SELECT site, max(v) AS v FROM (SELECT site, branch_id, sum(pp) AS v FROM ev WHERE branch_id NOT IN (1, 2, 3) GROUP BY ALL) GROUP BY 1),
 p AS (SELECT i AS site, coalesce((SELECT v FROM x WHERE x.site = i AND branch_id = 1), 0) AS v1, coalesce((SELECT v FROM x WHERE x.site = i AND branch_id = 2), 0) AS v2, coalesce((SELECT v FROM x WHERE x.site = i AND branch_id = 3), 0) AS v3, coalesce(o.v, 0) AS va FROM range(97) r(i) LEFT JOIN o ON o.site = i)
 SELECT CAST(site AS INT) AS site, ((round(v1, 9) >= 0.5 OR round(v2, 9) >= 0.5) AND round(v3, 9) >= 0.5) AND NOT (round(va, 9) >= 2) AS member,
  CASE WHEN ((round(v1, 9) >= 0.5 OR round(v2, 9) >= 0.5) AND round(v3, 9) >= 0.5) AND NOT (round(va, 9) >= 2) THEN round(least(greatest(CASE WHEN round(v1, 9) >= 0.5 THEN v1 ELSE 0 END, CASE WHEN round(v2, 9) >= 0.5 THEN v2 ELSE 0 END), v3), 6) ELSE 0 END AS probability FROM p""")
def set_expression_sites(spark, sf):
    s = events(spark, sf).groupBy("site", "branch_id").agg(F.sum("pp").alias("v"))
    named = set_expression.branches("((1|2)&3)-A")
    wide = s.groupBy("site").agg(*[F.sum(F.when(F.col("branch_id") == b, F.col("v"))).alias(f"v{b}") for b in named], F.max(F.when(~F.col("branch_id").isin(named), F.col("v"))).alias("va"))
    wide = sites.fill_site_axis(wide, SITES).fillna(0.0)
    value = lambda c, least: set_expression.Value(F.round(c, 9) >= least, F.col(c))
    v = set_expression.compile_expression("((1|2)&3)-A", {b: value(f"v{b}", 0.5) for b in named}, value("va", 2))
    return wide.select("site", v.member.alias("member"), F.round(v.probability, 6).alias("probability"))


@query("WITH x AS (SELECT s_nationkey AS branch_id, CAST(s_suppkey % 97 AS INT) AS site, count(*) AS n FROM supplier GROUP BY ALL), g AS (SELECT branch_id, CAST(i AS INT) AS site FROM (SELECT DISTINCT branch_id FROM x) CROSS JOIN range(97) r(i)) SELECT g.branch_id, g.site, n, n IS NOT NULL AS is_retained FROM g LEFT JOIN x ON x.branch_id = g.branch_id AND x.site = g.site")
def site_axis_expand(spark, sf):
    x = t(spark, sf, "supplier").selectExpr("s_nationkey as branch_id", "cast(s_suppkey % 97 as int) as site").groupBy("branch_id", "site").agg(F.count(F.lit(1)).alias("n"))
    return sites.fill_site_axis(x, SITES, ["branch_id"]).select("branch_id", "site", "n", "is_retained")


_FT = "f AS (SELECT p_partkey * 3 % 1500 AS s, p_partkey * 3 % 1500 + p_size AS e, p_brand AS feature FROM part)"


@query(f"WITH {_FT} SELECT p_partkey AS position, coalesce(string_agg(DISTINCT feature, ';' ORDER BY feature), '') AS labels FROM part LEFT JOIN f ON p_partkey BETWEEN s AND e GROUP BY 1")
def range_join_features(spark, sf):
    p = t(spark, sf, "part")
    f = p.selectExpr("p_partkey * 3 % 1500 as start", "p_partkey * 3 % 1500 + p_size as end", "p_brand as feature")
    return sites.features_at(p.selectExpr("p_partkey as position"), f)


_PT = "pt AS (SELECT s_suppkey AS id, s_suppkey % 37 * 1.5 AS x, s_suppkey % 23 * 2.0 AS y, s_nationkey * 1.0 AS z FROM supplier)"


@query(f"WITH {_PT} SELECT a.id, count(b.id) AS degree, round(coalesce(sum(1 / (1 + sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)))), 0), 6) AS proximity FROM pt a LEFT JOIN pt b ON a.id <> b.id AND sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) <= 8 GROUP BY 1")
def distance_self_join(spark, sf):
    p = t(spark, sf, "supplier").selectExpr("s_suppkey as id", "s_suppkey % 37 * 1.5D as x", "s_suppkey % 23 * 2.0D as y", "s_nationkey * 1.0D as z")
    return sites.contacts(p).select("id", "degree", r("proximity"))


_SEQ = "translate(lpad(CAST(p_partkey * 7919 % 531441 AS VARCHAR), 9, '0'), '0123456789', 'ACGTACGT-N')"
_CODE = ", ".join(f"'{c}': '{aa}'" for c, aa in sequence.genetic_code(1).items() if aa != "*")


@query(f"WITH s AS (SELECT p_partkey, {_SEQ} AS q FROM part), c AS (SELECT p_partkey, i, substr(q, CAST(i * 3 + 1 AS BIGINT), 3) AS c FROM s, range(3) r(i)) SELECT p_partkey, string_agg(CASE WHEN c = '---' THEN '-' ELSE coalesce(map_extract(MAP {{{_CODE}}}, c)[1], 'X') END, '' ORDER BY i) AS aa FROM c GROUP BY 1")
def translate_codons(spark, sf):
    return t(spark, sf, "part").select("p_partkey", sequence.translate_aligned(F.expr(_SEQ.replace("VARCHAR", "STRING"))).alias("aa"))


@query(f"WITH s AS (SELECT p_partkey, p_partkey // 2 AS k, {_SEQ} AS q FROM part), c AS (SELECT x.k, i, substr(x.q, i, 1) AS a, substr(y.q, i, 1) AS b FROM s x JOIN s y ON x.k = y.k AND x.p_partkey < y.p_partkey, range(1, 10) r(i)) SELECT k, round(count(*) FILTER (a = b AND a <> '-' AND b <> '-') / CAST(nullif(count(*) FILTER (a <> '-' AND b <> '-'), 0) AS DOUBLE), 6) AS identity FROM c GROUP BY k")
def pair_identity(spark, sf):
    s = t(spark, sf, "part").select("p_partkey", F.expr("p_partkey div 2").alias("k"), F.expr(_SEQ.replace("VARCHAR", "STRING")).alias("q"))
    x, y = s.select("k", F.col("p_partkey").alias("i"), F.col("q").alias("x")), s.select("k", F.col("p_partkey").alias("j"), F.col("q").alias("y"))
    return x.join(y, "k").where("i < j").select("k", F.round(sequence.identity(F.col("x"), F.col("y")), 6).alias("identity"))


_TIPS = f"""q AS (SELECT p_partkey, {_SEQ} AS q FROM part), co AS (SELECT p_partkey, CAST(i AS INT) AS site, substr(q, CAST(i * 3 + 1 AS BIGINT), 3) AS c FROM q, range(3) r(i)),
 b AS (SELECT unnest(['A', 'C', 'G', 'T']) AS b), full_ AS (SELECT x.b || y.b || z.b AS s FROM b x, b y, b z WHERE x.b || y.b || z.b NOT IN ('TAA', 'TAG', 'TGA')),
 tip AS (SELECT p_partkey, site, s, 1.0 / count(*) OVER (PARTITION BY p_partkey, site) AS p FROM co JOIN full_ ON s LIKE replace(c, 'N', '_') WHERE c <> 'NNN')"""


def sequences(spark, sf):
    return t(spark, sf, "part").select(F.col("p_partkey").alias("seq_id"), F.expr(_SEQ.replace("VARCHAR", "STRING")).alias("sequence"))


@query(f"WITH {_TIPS} SELECT p_partkey AS seq_id, site, s AS state, round(p, 9) AS p FROM tip")
def tip_states(spark, sf):
    """States of sequences: an ambiguous codon is shared out over the sense codons that it can be."""
    return ancestral.tip_states(sequences(spark, sf)).select("seq_id", "site", "state", F.round("p", 9).alias("p"))


@query(f"WITH {_TIPS} SELECT s AS codon, round(sum(p) / (SELECT sum(p) FROM tip), 9) AS freq FROM tip GROUP BY 1")
def codon_frequencies(spark, sf):
    return ancestral.codon_frequencies(sequences(spark, sf)).select("codon", F.round("freq", 9).alias("freq"))


@query("WITH s AS (SELECT DISTINCT s_nationkey AS k, CAST(s_suppkey % 97 AS INT) AS site FROM supplier), w AS (SELECT *, lag(site) OVER (PARTITION BY k ORDER BY site) AS p FROM s) SELECT k, site FROM s UNION SELECT k, CAST(i AS INT) FROM w, range(97) r(i) WHERE p < site - 1 AND i < site AND i >= site - 2")
def run_extension(spark, sf):
    s = t(spark, sf, "supplier").selectExpr("s_nationkey as k", "cast(s_suppkey % 97 as int) as site")
    return sites.extend_backwards(s, 2, ["k"])


@query(f"WITH {EV}, x AS (SELECT branch_id, sum(pp) AS sub FROM ev GROUP BY 1) SELECT branch_id, round(sub, 6) AS sub, n_name AS branch_name FROM x JOIN nation ON n_nationkey = branch_id")
def merge_tables(spark, sf):
    n = t(spark, sf, "nation").selectExpr("n_nationkey as branch_id", "n_name as branch_name")
    return combine.merge_tables(ev.branch_totals(events(spark, sf)), n).select("branch_id", r("sub"), "branch_name")


@query(f"{_CB}, tt AS (SELECT branch_id, sum(pp) AS n FROM ev GROUP BY 1) SELECT branch_id_1, branch_id_2, round(x.n, 6) AS sub_1, round(y.n, 6) AS sub_2 FROM cb LEFT JOIN tt x ON x.branch_id = branch_id_1 LEFT JOIN tt y ON y.branch_id = branch_id_2")
def substitutions_per_branch(spark, sf):
    cb = combine.with_branch_totals(free_pairs(spark, sf), ev.branch_totals(events(spark, sf)), 2)
    return cb.select(*combine.ids(2), r("sub_1"), r("sub_2"))


@query(f"WITH {EV} SELECT branch_id, string_agg(x, ',' ORDER BY m DESC, d) AS distribution FROM (SELECT branch_id, d, round(sum(pp), 3) AS m, d || ':' || printf('%.6g', round(sum(pp), 3)) AS x FROM ev GROUP BY branch_id, d) GROUP BY 1")
def state_distribution(spark, sf):
    e = events(spark, sf).groupBy("branch_id", "d").agg(F.round(F.sum("pp"), 3).alias("pp"))
    return ev.state_distribution(e, ["branch_id"], "d")


@query("WITH x AS (SELECT CAST(l_partkey % 97 AS INT) AS site, l_suppkey % 10 AS tip, sum(l_discount) AS p FROM lineitem WHERE l_partkey % 11 <> l_suppkey % 10 GROUP BY ALL) SELECT site, round(1 - count(*) FILTER (p > 0) / 10.0, 6) AS gap_rate FROM x GROUP BY 1")
def gap_rate(spark, sf):
    s = t(spark, sf, "lineitem").where("l_partkey % 11 <> l_suppkey % 10").selectExpr("cast(l_partkey % 97 as int) as site", "l_suppkey % 10 as tip", "l_discount as p")
    return sites.gap_rates(s, 10).select("site", r("gap_rate"))


@query("WITH s AS (SELECT l_orderkey AS site, l_linenumber AS tip, l_returnflag AS state, CAST(l_linenumber % 7 <> 0 AS INT) + CAST(l_linenumber = 5 AS INT) AS candidates FROM lineitem) SELECT site FROM s GROUP BY site HAVING count(*) FILTER (candidates = 1) > 0 AND max(candidates) <= 1 AND count(DISTINCT state) FILTER (candidates = 1) = 1")
def tip_invariant_sites(spark, sf):
    s = t(spark, sf, "lineitem").selectExpr("l_orderkey as site", "l_linenumber as tip", "l_returnflag as state", "cast(l_linenumber % 7 <> 0 as int) + cast(l_linenumber = 5 as int) as candidates")
    return ev.invariant_tip_sites(s)


@query("""WITH c AS (SELECT c_mktsegment, CAST(count(*) FILTER (c_acctbal > 0) AS DOUBLE) AS n1, CAST(count(*) FILTER (c_acctbal <= 0) AS DOUBLE) AS s1, CAST(count(*) FILTER (c_nationkey > 9) AS DOUBLE) AS n2, CAST(count(*) FILTER (c_nationkey <= 9) AS DOUBLE) AS s2 FROM customer GROUP BY 1),
 e AS (SELECT *, n1 + s1 + n2 + s2 AS t, (n1 + s1) * (n1 + n2) / (n1 + s1 + n2 + s2) AS x FROM c), k AS (SELECT *, sign(x - n1) * least(0.5, abs(x - n1)) AS h FROM e),
 y AS (SELECT c_mktsegment, t, n1 + h AS a, s1 - h AS b, n2 - h AS c, s2 + h AS d FROM k)
 SELECT c_mktsegment, round(2 * (a*ln(a*t/((a+b)*(a+c))) + b*ln(b*t/((a+b)*(b+d))) + c*ln(c*t/((c+d)*(a+c))) + d*ln(d*t/((c+d)*(b+d)))), 6) AS g FROM y""")
def g_test(spark, sf):
    one = lambda e: F.count_if(F.expr(e)).cast("double")
    c = t(spark, sf, "customer").groupBy("c_mktsegment").agg(one("c_acctbal > 0").alias("n1"), one("c_acctbal <= 0").alias("s1"), one("c_nationkey > 9").alias("n2"), one("c_nationkey <= 9").alias("s2"))
    return c.select("c_mktsegment", F.round(rates.g_test(*[F.col(x) for x in ("n1", "s1", "n2", "s2")]), 6).alias("g"))



@query("SELECT o.o_orderkey, count(l.l_linenumber) FILTER (l.l_extendedprice * 4 >= o.o_totalprice) AS ge, count(l.l_linenumber) AS n, round((count(l.l_linenumber) FILTER (l.l_extendedprice * 4 >= o.o_totalprice) + 1) / (count(l.l_linenumber) + 1.0), 6) AS p FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey, o.o_totalprice")
def empirical_pvalues(spark, sf):
    o = t(spark, sf, "orders").selectExpr("o_orderkey", "o_totalprice as x")
    p = t(spark, sf, "lineitem").selectExpr("l_orderkey as o_orderkey", "l_extendedprice * 4 as x")
    return rates.empirical_p(o, p, ["o_orderkey"], "x").select("o_orderkey", "ge", "n", r("p"))


def draws(spark, sf):
    """branch_id, n: each branch's own number of substitutions (rounded, so that a sum's last bits don't make a draw)."""
    return ev.branch_totals(events(spark, sf), branches(spark, sf)).select("branch_id", F.round("sub", 9).alias("n"))


@query()
def permuted_overlap(spark, sf, rounds: int = 20):
    """Null distribution of shared sites of all independent pairs by weighted draws of each branch's own number (seeded; no SQL twin)."""
    bs = events(spark, sf).groupBy("branch_id", "site").agg(F.sum("pp").alias("sub"))
    w = expected.site_weights(bs, SITES).select("branch_id", "site", "weight")
    return expected.permuted_overlaps(w, draws(spark, sf), free_pairs(spark, sf), rounds).groupBy(*combine.ids(2)).agg(F.avg("overlap").alias("mean_overlap"))


@query()
def urn_inclusion(spark, sf):
    """Inclusion probabilities of Fisher's urn with each branch's own number of draws (no SQL twin)."""
    bs = events(spark, sf).groupBy("branch_id", "site").agg(F.sum("pp").alias("sub"))
    w = expected.site_weights(bs, SITES).select("branch_id", "site", "weight")
    return expected.inclusion(w, draws(spark, sf)).select("branch_id", "site", r("weight"))
