"""Site tables: specificity, gap filling, annotation by ranges and distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def specificity(values: DataFrame, key: str, category: str, value: str) -> DataFrame:
    """tau, entropy (base 2) and tsi of each key over its categories.

    tau = sum(1 - x / max) / (n - 1) over n categories of the whole table,
    absent ones being 0; tsi = max / sum.
    """
    n = values.agg(F.count_distinct(category).alias("n"))
    g = values.groupBy(key, category).agg(F.sum(value).alias("x"))
    t = g.groupBy(key).agg(F.sum("x").alias("s"), F.max("x").alias("m")).where("m > 0")
    j = g.join(t, key).withColumn("q", F.col("x") / F.col("s"))
    h = j.groupBy(key).agg(F.first("s").alias("s"), F.first("m").alias("m"), (-F.sum(F.when(F.col("q") > 0, F.col("q") * F.log2("q")).otherwise(0.0))).alias("entropy")).join(F.broadcast(n))
    return h.select(key, F.when(F.col("n") > 1, (F.col("n") - F.col("s") / F.col("m")) / (F.col("n") - 1)).otherwise(0.0).alias("tau"), "entropy", (F.col("m") / F.col("s")).alias("tsi"))


def fill_site_axis(df: DataFrame, n_sites: int, groups: list[str] | None = None) -> DataFrame:
    """Every group on the full axis 0 .. n_sites - 1; is_retained tells the rows that were there."""
    axis = df.sparkSession.range(n_sites).select(F.col("id").cast("int").alias("site"))
    grid = df.select(*groups).distinct().crossJoin(F.broadcast(axis)) if groups else axis
    return grid.join(df.withColumn("is_retained", F.lit(True)), [*(groups or []), "site"], "left").fillna(False, ["is_retained"])


def features_at(positions: DataFrame, features: DataFrame, span: int = 64) -> DataFrame:
    """position, labels: names of the features (start, end, feature) that enclose each position, sorted; '' without any.

    A range join by cells: a feature is listed in the cells of ``span``
    positions it touches, so both sides equi-join.
    """
    cells = features.withColumn("cell", F.explode(F.sequence(F.floor(F.col("start") / span), F.floor(F.col("end") / span))))
    p = positions.select("position").distinct().withColumn("cell", F.floor(F.col("position") / span))
    hit = p.join(cells, "cell").where("position between start and end")
    found = hit.groupBy("position").agg(F.array_join(F.array_sort(F.collect_set("feature")), ";").alias("labels"))
    return positions.select("position").distinct().join(found, "position", "left").fillna("", ["labels"])


def informative_features(labels: DataFrame, positions: int) -> DataFrame:
    """Features of (position, feature) rows that don't cover all ``positions``."""
    return labels.groupBy("feature").agg(F.count_distinct("position").alias("n")).where(F.col("n") < positions).select("feature")


def _near(left: DataFrame, right: DataFrame, cutoff: float, keys: list[str]) -> DataFrame:
    """Rows of both sides (x, y, z; columns of ``right`` as o_...) within ``cutoff`` and with equal ``keys``, and their ``dist``.

    A distance join on a grid of cubes of that size: each place meets those of
    its own and the 26 cubes around it.
    """
    own = left.select("*", *[F.floor(F.col(c) / cutoff).cast("long").alias(f"c{c}") for c in "xyz"])
    near = right.select(*keys, *[F.col(c).alias(f"o_{c}") for c in right.columns if c not in keys], *[F.floor(F.col(c) / cutoff).cast("long").alias(f"c{c}") for c in "xyz"])
    for c in ("cz", "cy", "cx"):
        near = near.withColumn(c, F.explode(F.array(*[F.col(c) + i for i in (-1, 0, 1)])))
    d2 = sum(((F.col(c) - F.col(f"o_{c}")) * (F.col(c) - F.col(f"o_{c}")) for c in "xyz"), F.lit(0.0))
    return own.join(near, [*keys, "cx", "cy", "cz"]).withColumn("dist", F.sqrt(d2)).where(F.col("dist") <= cutoff)


def contacts(points: DataFrame, cutoff: float = 8.0) -> DataFrame:
    """id, degree, proximity: rows of other ids (id, x, y, z) within ``cutoff``, and the sum of 1 / (1 + distance).

    Places are joined, not rows: what lies around a place is counted once for
    all that lie there, and each id then takes off its own rows. So copies cost
    no pairs. A row without an id or a coordinate has no contact and is none.
    """
    rows = points.where("id is not null").groupBy("id", "x", "y", "z").agg(F.count(F.lit(1)).alias("n")).where("x is not null and y is not null and z is not null")
    places = rows.groupBy("x", "y", "z").agg(F.sum("n").alias("n"))
    sums = [F.sum("o_n").alias("all_n"), F.sum(F.col("o_n") / (1 + F.col("dist"))).alias("all_p")]
    around = _near(places, places, cutoff, []).groupBy("x", "y", "z").agg(*sums)
    every = rows.join(around, ["x", "y", "z"]).groupBy("id").agg(F.sum(F.col("n") * F.col("all_n")).alias("all_n"), F.sum(F.col("n") * F.col("all_p")).alias("all_p"), F.sum("n").alias("rows"))
    # an id in one row meets only itself, at distance 0; the few others are joined with their own rows
    many = rows.join(every.where("rows > 1").select("id"), "id", "left_semi")
    own = _near(many, many, cutoff, ["id"]).groupBy("id").agg(F.sum(F.col("n") * F.col("o_n")).alias("own_n"), F.sum(F.col("n") * F.col("o_n") / (1 + F.col("dist"))).alias("own_p"))
    g = every.join(own, "id", "left").select("id", (F.col("all_n") - F.coalesce("own_n", F.lit(1))).alias("degree"), (F.col("all_p") - F.coalesce("own_p", F.lit(1.0))).alias("proximity"))
    g = g.withColumn("proximity", F.when(F.col("degree") > 0, F.col("proximity")).otherwise(0.0))
    return points.select("id").distinct().join(g, "id", "left").fillna({"degree": 0, "proximity": 0.0})


def extend_backwards(sites: DataFrame, n: int, keys: list[str] | None = None) -> DataFrame:
    """Sites plus, before each run of consecutive ones but the first, the ``n`` sites that precede it (none below 0)."""
    keys = keys or []
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("site")
    start = sites.select(*keys, "site").distinct().withColumn("prev", F.lag("site").over(w)).where("prev < site - 1")
    before = start.select(*keys, F.explode(F.sequence(F.greatest(F.col("site") - n, F.lit(0)), F.col("site") - 1)).alias("site"))
    return sites.select(*keys, "site").union(before.select(*keys, F.col("site").cast(sites.schema["site"].dataType))).distinct()


def classify(df: DataFrame, convergent: str, divergent: str, least: float) -> DataFrame:
    """category: 'convergent' or 'divergent', whichever reaches ``least`` and is larger (a tie is convergent), else 'blank'; NaN and null count as 0."""
    c, d = (F.coalesce(F.nanvl(F.col(x), F.lit(0.0)), F.lit(0.0)) for x in (convergent, divergent))
    return df.withColumn("category", F.when((c >= least) & (c >= d), "convergent").when((d >= least) & (d > c), "divergent").otherwise("blank"))


def gap_rates(states: DataFrame, n_tips: int) -> DataFrame:
    """site, gap_rate: share of the tips without any state mass, from (site, tip, p)."""
    seen = states.groupBy("site", "tip").agg(F.sum("p").alias("p")).where("p > 0").groupBy("site").agg(F.count(F.lit(1)).alias("k"))
    every = states.select("site").distinct()
    return every.join(seen, "site", "left").select("site", (1 - F.coalesce("k", F.lit(0)) / n_tips).alias("gap_rate"))
