"""Branch combinations: generation, independence, expansion by one branch, and their counts."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import difference
from ..plans.settled import settled
from .events import FEATURES, projections


def ids(k: int) -> list[str]:
    return [f"branch_id_{i}" for i in range(1, k + 1)]


def pairs(branches: DataFrame) -> DataFrame:
    """All pairs of different branches, smaller id first (branches of a tree are few)."""
    x, y = branches.select(F.col("branch_id").alias("branch_id_1")), branches.select(F.col("branch_id").alias("branch_id_2"))
    return x.join(F.broadcast(y), F.col("branch_id_1") < F.col("branch_id_2"))


def independent(combinations: DataFrame, dependent: DataFrame, k: int) -> DataFrame:
    """Combinations of which no two members are a dependent pair (lo, hi)."""
    c = combinations
    for i in range(1, k + 1):
        for j in range(i + 1, k + 1):
            a, b = F.col(f"branch_id_{i}"), F.col(f"branch_id_{j}")
            c = c.join(dependent, (F.least(a, b) == F.col("lo")) & (F.greatest(a, b) == F.col("hi")), "left_anti")
    return c


def constrained(branches: DataFrame, dependent: DataFrame, k: int) -> DataFrame:
    """All combinations of ``k`` branches of which no two are a dependent pair (lo, hi), ids ascending.

    Each combination carries, as bits in an array of longs, the larger branches
    that agree with all of its members; it grows by each of them in turn, so
    none with a dependent pair is ever formed. A tree's branches are few; the
    table of their bits is broadcast below BITS_BROADCAST branches.
    """
    if k < 1:
        raise ValueError("k must be positive")
    own = settled(branches.select("branch_id").distinct().withColumn("i", F.row_number().over(Window.orderBy("branch_id")) - 1))
    n = own.count()
    words = max(-(-n // 64), 1)
    x, y = own.select(F.col("branch_id").alias("lo"), F.col("i")), own.select(F.col("branch_id").alias("hi"), F.col("i").alias("j"))
    clash = dependent.select(F.least("lo", "hi").alias("lo"), F.greatest("lo", "hi").alias("hi")).distinct().join(x, "lo").join(y, "hi").select("i", "j")
    # bits of all larger branches, less those of the dependent ones
    cut = clash.groupBy("i").agg(F.collect_set("j").alias("cut"))
    bit = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.when(_agrees(w * 64 + b, n), F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))
    bits = own.join(cut, "i", "left").withColumn("cut", F.coalesce("cut", F.array().cast("array<int>"))).select("i", "branch_id", F.transform(F.sequence(F.lit(0), F.lit(words - 1)), bit).alias("bits"))
    bits = settled(bits)
    out = bits.select(F.col("branch_id").alias("branch_id_1"), "bits")
    more = bits.select(F.col("i").alias("_next"), "branch_id", F.col("bits").alias("_bits"))
    for size in range(2, k + 1):
        able = F.filter(F.sequence(F.lit(0), F.lit(max(n - 1, 0))), lambda j: F.getbit(F.get("bits", F.floor(j / 64).cast("int")), j % 64) == 1)
        grown = out.withColumn("_next", F.explode(able)).join(F.broadcast(more) if n <= BITS_BROADCAST else more, "_next")
        both = F.zip_with("bits", "_bits", lambda a, b: a.bitwiseAND(b))
        out = grown.select(*ids(size - 1), F.col("branch_id").alias(f"branch_id_{size}"), both.alias("bits"))
        if size < k:
            out = out.repartition(*ids(size))  # combinations grow unevenly
    return out.select(*ids(k))


#: Branches whose bits are broadcast at most.
BITS_BROADCAST = 10_000


def _agrees(j, n: int):
    return (j > F.col("i")) & (j < n) & ~F.array_contains("cut", j)


def dependent_pairs(nodes: DataFrame, sisters: bool = True, root_has_states: bool = True) -> DataFrame:
    """Pairs of branches that can't be independent: ancestor and descendant, and sisters.

    nodes: node, parent (null for the root). Without states at the root, the
    branches below it also conflict with all outside their clade.
    """
    up = nodes.select("node", "parent").where("parent is not null")
    chain, step = up, up
    while True:  # one round a level of the tree
        step = step.select("node", F.col("parent").alias("via")).join(F.broadcast(up.select(F.col("node").alias("via"), "parent")), "via").select("node", "parent")
        if not step.limit(1).count():
            break
        chain = chain.union(step)
    out = chain.select(F.least("node", "parent").alias("lo"), F.greatest("node", "parent").alias("hi"))
    if sisters:
        other = up.select(F.col("node").alias("other"), "parent")
        out = out.union(up.join(other, "parent").where("node < other").select(F.col("node").alias("lo"), F.col("other").alias("hi")))
    if not root_has_states:
        root = nodes.where("parent is null").select(F.col("node").alias("parent"))
        top = up.join(F.broadcast(root), "parent").select(F.col("node").alias("top"))
        below = chain.select(F.col("node").alias("inner"), F.col("parent").alias("top"))
        outside = top.join(F.broadcast(nodes.where("parent is not null").select("node")), F.col("top") != F.col("node")).join(below.withColumnRenamed("inner", "node"), ["top", "node"], "left_anti")
        out = out.union(outside.select(F.least("top", "node").alias("lo"), F.greatest("top", "node").alias("hi")))
    return out.distinct()


def expand(combinations: DataFrame, k: int, dependent: DataFrame | None = None) -> DataFrame:
    """Combinations of k + 1 branches that are unions of two of k sharing k - 1 (Apriori), independent ones only."""
    members = combinations.select(F.array_sort(F.array(*ids(k))).alias("m"))
    one = F.transform(F.col("m"), lambda x: F.struct(F.array_except(F.col("m"), F.array(x)).alias("rest"), x.alias("left")))
    parts = members.select(F.explode(one).alias("p")).select("p.rest", "p.left")
    both = parts.join(parts.select("rest", F.col("left").alias("right")), "rest").where("left < right")
    union = both.select(F.array_sort(F.concat("rest", F.array("left", "right"))).alias("m")).distinct()
    out = union.select(*[F.col("m")[i].alias(c) for i, c in enumerate(ids(k + 1))])
    return out if dependent is None else independent(out, dependent, k + 1)


def trait_unions(sets: DataFrame, k: int, dependent: DataFrame | None = None) -> DataFrame:
    """Combinations of ``k`` branches from the sets (trait, members) of each trait by itself (``unions``), each once over all traits, independent ones only."""
    s = sets.select("trait", F.array_sort(F.array_distinct("members")).alias("m")).distinct()
    part = s.select("trait", "m", F.explode("m").alias("b"))
    both = part.join(part.withColumnRenamed("m", "n"), ["trait", "b"]).where(F.array_join("m", ",") < F.array_join("n", ",")).select(F.array_sort(F.array_union("m", "n")).alias("m"))
    rows = both.unionByName(s.select("m")).where(F.size("m") == k).distinct()
    out = rows.select(*[F.col("m")[i].alias(c) for i, c in enumerate(ids(k))])
    return out if dependent is None else independent(out, dependent, k)


def active_branches(*events: DataFrame) -> DataFrame:
    """branch_id of the branches that have events in any of the channels, each once."""
    return reduce(lambda a, b: a.union(b), [e.where("pp > 0").select("branch_id") for e in events]).distinct()


def unions(sets: DataFrame, k: int) -> DataFrame:
    """Combinations of ``k`` branches that are unions of two given sets (column members, an array) that share a member; sets of k are kept as they are.

    Sets meet by their members, so no pair without a common one is formed.
    """
    s = sets.select(F.array_sort(F.array_distinct("members")).alias("m")).distinct()
    part = s.select("m", F.explode("m").alias("b"))
    other = part.withColumnRenamed("m", "n")
    both = part.join(other, "b").where(F.array_join("m", ",") < F.array_join("n", ",")).select(F.array_sort(F.array_union("m", "n")).alias("m"))
    out = both.unionByName(s).where(F.size("m") == k).distinct()
    return out.select(*[F.col("m")[i].alias(c) for i, c in enumerate(ids(k))])


def _met(projection: DataFrame, features: list[str], combinations: DataFrame, k: int) -> DataFrame:
    """ids, site, features, v: the product of the members' values wherever all of them have one.

    Members are added one by one where they meet, by site and features, so that
    a branch without mass makes no row; what can't become a wanted combination
    goes at once. Ids ascend within a combination.
    """
    side = lambda i: projection.select(F.col("branch_id").alias(f"branch_id_{i}"), "site", *features, F.col("v").alias(f"v_{i}"))
    out = side(1)
    for i in range(2, k + 1):
        wanted = combinations.select(*ids(i)) if i == k else combinations.select(*ids(i)).distinct()
        out = out.join(side(i), ["site", *features]).where(F.col(f"branch_id_{i - 1}") < F.col(f"branch_id_{i}")).join(wanted, ids(i), "left_semi")
    return out.select(*ids(k), "site", *features, reduce(lambda a, b: a * b, [F.col(f"v_{i}") for i in range(1, k + 1)]).alias("v"))


def _products(projection: DataFrame, features: list[str]) -> DataFrame:
    """branch_id_1 < branch_id_2, stat, v: sums over sites and features of the products of two branches' values.

    A task holds the sites that are dealt to it and multiplies matrices of
    branches by (site, features) columns, a block of columns at a time; what it
    returns is a value for each pair, so no row is made for a pair at a site.
    """
    kind = projection.schema["branch_id"].dataType.simpleString()
    columns = ["site", *features]

    def coded(c: pa.ChunkedArray) -> tuple[np.ndarray, int]:
        d = c.combine_chunks().dictionary_encode(null_encoding="encode")
        return np.asarray(d.indices, np.int64), max(len(d.dictionary), 1)

    def run(batches):
        parts = list(batches)
        if not parts:
            return
        rows = pa.Table.from_batches(parts)
        branch, row = np.unique(rows.column("branch_id").to_numpy(), return_inverse=True)
        value, column = rows.column("v").to_numpy(), np.zeros(len(rows), np.int64)
        for c in columns:
            number, size = coded(rows.column(c))
            column = column * size + number
        kind_of, names = coded(rows.column("stat"))[0], rows.column("stat").combine_chunks().dictionary_encode().dictionary.to_pylist()
        for k, stat in enumerate(names):
            own = np.flatnonzero(kind_of == k)
            place = np.unique(column[own], return_inverse=True)[1]
            order = np.argsort(place, kind="stable")
            own, place = own[order], place[order]
            total = np.zeros((len(branch), len(branch)))
            for first in range(0, int(place[-1]) + 1, COLUMNS):
                lo, hi = np.searchsorted(place, [first, first + COLUMNS])
                block = np.zeros((len(branch), COLUMNS))
                np.add.at(block, (row[own[lo:hi]], place[lo:hi] - first), value[own[lo:hi]])
                total += block @ block.T
            i, j = np.triu_indices(len(branch), 1)
            keep = total[i, j] != 0
            yield pa.RecordBatch.from_arrays([pa.array(branch[i[keep]]), pa.array(branch[j[keep]]), pa.array([stat] * int(keep.sum()), pa.string()), pa.array(total[i, j][keep])], ["branch_id_1", "branch_id_2", "stat", "v"])

    wanted = projection.select("branch_id", *columns, "v").where(F.col("v").isNotNull()).repartition("site")
    return wanted.mapInArrow(run, f"branch_id_1 {kind}, branch_id_2 {kind}, stat string, v double")


#: Branches of which a task may hold all pairs, and columns that it multiplies at once.
PAIRED_BRANCHES, COLUMNS = 2048, 4096


def counts_of(projections: DataFrame, combinations: DataFrame, k: int = 2, prefix: str = "OCN", stats=tuple(FEATURES), by: tuple[str, ...] | None = None) -> DataFrame:
    """Convergence counts from the projections of all statistics (as events.projections gives them), one column for each, 0 where nothing meets.

    One join for all statistics, which are told apart by their key, and one sum;
    for pairs of a tree's branches a product of matrices in its place.
    ``by``: grouping of the result; the combination's ids for the cb table, plus
    'site' for cbs, only 'site' for cs.
    """
    keys = list(by) if by else ids(k)
    features = ["stat", *FEATURES["spe2spe"]]
    if k == 2 and by is None and projections.select("branch_id").distinct().count() <= PAIRED_BRANCHES:
        met = _products(projections, features).join(combinations.select(*ids(2)), ids(2), "left_semi")
    else:
        met = _met(projections, features, combinations, k)
    out = met.groupBy(*keys).agg(*[F.sum(F.when(F.col("stat") == s, F.col("v"))).alias(f"{prefix}{s}") for s in stats])
    if by is None:
        out = combinations.select(*keys).join(out, keys, "left")
    return out.fillna(0.0, [f"{prefix}{s}" for s in stats])


def counts(events: DataFrame, combinations: DataFrame, k: int = 2, prefix: str = "OCN", stats=tuple(FEATURES), by: tuple[str, ...] | None = None) -> DataFrame:
    """Convergence counts of each combination from events; columns and ``by`` as in counts_of."""
    return counts_of(settled(projections(events, stats)), combinations, k, prefix, stats, by)


def nan_below_root(cb: DataFrame, below_root: DataFrame, k: int, prefix: str = "E") -> DataFrame:
    """Columns that start with ``prefix`` become NaN where a member is one of the branches (branch_id) right below the root."""
    columns = [c for c in cb.columns if c.startswith(prefix)]
    hit = F.lit(False)
    for i in range(1, k + 1):
        cb = cb.join(F.broadcast(below_root.select(F.col("branch_id").alias(f"branch_id_{i}"), F.lit(True).alias(f"_below_{i}"))), f"branch_id_{i}", "left")
        hit = hit | F.coalesce(f"_below_{i}", F.lit(False))
    return cb.withColumns({c: F.when(hit, F.lit(float("nan"))).otherwise(F.col(c)) for c in columns}).drop(*[f"_below_{i}" for i in range(1, k + 1)])


def add_differences(cb: DataFrame, prefix: str) -> DataFrame:
    """The derived statistics any2dif, spe2dif, dif2any, dif2spe and dif2dif."""
    c = lambda s: F.col(f"{prefix}{s}")
    cb = cb.withColumns({f"{prefix}any2dif": difference(c("any2any"), c("any2spe")), f"{prefix}spe2dif": difference(c("spe2any"), c("spe2spe")), f"{prefix}dif2any": difference(c("any2any"), c("spe2any")), f"{prefix}dif2spe": difference(c("any2spe"), c("spe2spe"))})
    return cb.withColumn(f"{prefix}dif2dif", difference(c("any2dif"), c("spe2dif")))


def add_some_differences(cb: DataFrame, prefix: str, names: list[str]) -> DataFrame:
    """The named derived statistics, in an order that lets dif2dif use any2dif and spe2dif."""
    c = lambda s: F.col(f"{prefix}{s}")
    whole = {"any2dif": ("any2any", "any2spe"), "spe2dif": ("spe2any", "spe2spe"), "dif2any": ("any2any", "spe2any"), "dif2spe": ("any2spe", "spe2spe"), "dif2dif": ("any2dif", "spe2dif")}
    for s, (x, y) in whole.items():
        if s in names:
            cb = cb.withColumn(f"{prefix}{s}", difference(c(x), c(y)))
    return cb


def with_branch_totals(cb: DataFrame, totals: DataFrame, k: int, name: str = "sub") -> DataFrame:
    """Adds each member branch's total as name_1 .. name_k."""
    for i in range(1, k + 1):
        t = totals.select(F.col("branch_id").alias(f"branch_id_{i}"), F.col(name).alias(f"{name}_{i}"))
        cb = cb.join(F.broadcast(t), f"branch_id_{i}", "left")
    return cb


def branch_distances(nodes: DataFrame) -> DataFrame:
    """x, y, dist, steps of each two nodes with x < y: the length of the path between them less y's own branch, and the path's number of branches.

    nodes: node, ancestor, depth (its number of steps up), length (its distance
    up); each node is its own ancestor at depth 0. The nearest common ancestor
    is found by a join on ancestors.
    """
    a = nodes.select(F.col("node").alias("x"), "ancestor", F.col("depth").alias("dx"), F.col("length").alias("lx"))
    b = nodes.select(F.col("node").alias("y"), "ancestor", F.col("depth").alias("dy"), F.col("length").alias("ly"))
    near = a.join(b, "ancestor").where("x < y").groupBy("x", "y").agg(F.min(F.struct((F.col("dx") + F.col("dy")).alias("steps"), (F.col("lx") + F.col("ly")).alias("dist"))).alias("m"))
    own = nodes.where("depth = 1").select(F.col("node").alias("y"), F.col("length").alias("own"))
    return near.join(own, "y", "left").select("x", "y", (F.col("m.dist") - F.coalesce("own", F.lit(0.0))).alias("dist"), "m.steps")


def max_distance(cb: DataFrame, distances: DataFrame, k: int) -> DataFrame:
    """The largest distance between two members, from distances (x, y, dist) with x < y."""
    for i in range(1, k + 1):
        for j in range(i + 1, k + 1):
            d = distances.select("x", "y", F.col("dist").alias(f"dist_{i}_{j}"))
            cb = cb.join(d, (F.col(f"branch_id_{i}") == F.col("x")) & (F.col(f"branch_id_{j}") == F.col("y")), "left").drop("x", "y")
    each = [f"dist_{i}_{j}" for i in range(1, k + 1) for j in range(i + 1, k + 1)]
    return cb.withColumn("dist", F.greatest(*each) if len(each) > 1 else F.col(each[0])).drop(*each)


def merge_tables(x: DataFrame, y: DataFrame) -> DataFrame:
    """Inner join on the id columns (branch_name*, branch_id*, site*) that both tables have."""
    keys = [c for c in x.columns if c in y.columns and c.startswith(("branch_name", "branch_id", "site"))]
    return x.join(y, keys)


def sort_ids(cb: DataFrame, k: int) -> DataFrame:
    """Ids ascending within each row."""
    m = cb.withColumn("_m", F.array_sort(F.array(*ids(k))))
    return m.withColumns({c: F.col("_m")[i] for i, c in enumerate(ids(k))}).drop("_m")
