"""Ranks, quantiles, multiple testing and representative rows.

Global ranks don't need one unpartitioned window: values are counted first, the
counts are range-partitioned and summed within and across partitions, and the
ranks are joined back by value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.numeric import finite
from ..plans.settled import settled


def _beside(df: DataFrame, stats: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the statistics of their keys; without keys those are one row, else as many as there are keys and left to the planner."""
    return df.join(stats, keys, "left") if keys else df.join(F.broadcast(stats))


def running_counts(values: DataFrame, keys: list[str], value: str, buckets: int = 64, ranges: bool = False) -> DataFrame:
    """keys, value, n (rows of that value), below (rows with a smaller value); with ``ranges`` also part, the number of its range.

    Rows are counted per value, values are cut into ``buckets`` ranges (a multiple of 8) by
    approximate quantiles, and a window runs over each (keys, range): no task
    sees more than a range of distinct values.
    """
    n = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    cuts = n.groupBy(*keys).agg(F.percentile_approx(value, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 1000).alias("cuts")) if keys else n.agg(F.percentile_approx(value, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 1000).alias("cuts"))
    # a value's range is found among every eighth cut, then among the seven behind that one
    eighths = F.array(*[F.get("cuts", F.lit(i)) for i in range(7, buckets - 1, 8)]).alias("eighths")
    cuts = cuts.select(*keys, eighths, F.array(*[F.slice("cuts", 8 * k + 1, 7) for k in range(buckets // 8)]).alias("fine"))
    placed = _beside(n, cuts, keys)
    below = lambda c: F.size(F.filter(c, lambda x: x < F.col(value)))
    placed = placed.withColumn("_k", below("eighths")).withColumn("part", 8 * F.col("_k") + below(F.get("fine", F.col("_k")))).drop("eighths", "fine", "_k")
    whole = placed.groupBy(*keys, "part").agg(F.sum("n").alias("m"))
    offsets = whole.withColumn("offset", F.sum("m").over((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy("part")) - F.col("m")).drop("m")
    within = F.sum("n").over(Window.partitionBy(*keys, "part").orderBy(value)) - F.col("n")
    return placed.withColumn("within", within).join(offsets if keys else F.broadcast(offsets), [*keys, "part"]).select(*keys, value, "n", (F.col("offset") + F.col("within")).alias("below"), *(["part"] if ranges else []))


def average_rank(df: DataFrame, value: str, keys: list[str] | None = None, out: str = "avg_rank") -> DataFrame:
    """Adds the average rank (from 1; equal values share) among finite values; null for others."""
    keys = keys or []
    r = running_counts(df.where(finite(F.col(value))).select(*keys, value), keys, value)
    return df.join(r.select(*keys, value, (F.col("below") + (F.col("n") + 1) / 2).alias(out)), [*keys, value], "left")


def rank_quantile(df: DataFrame, value: str, keys: list[str] | None = None, out: str = "quantile") -> DataFrame:
    """Average rank over the number of finite values."""
    keys = keys or []
    n = df.where(finite(F.col(value))).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = average_rank(df, value, keys, "_r")
    ranked = _beside(ranked, n, keys)
    return ranked.withColumn(out, F.col("_r") / F.col("_n")).drop("_r", "_n")


def bh_qvalues(df: DataFrame, p: str, keys: list[str] | None = None, out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q-values among finite p, overall or within ``keys``: a suffix minimum of p * n / rank over distinct p.

    The minimum runs within each range of running_counts; those of the later
    ranges, one row each, are joined to it.
    """
    keys = keys or []
    r = running_counts(df.where(finite(F.col(p))).select(*keys, p), keys, p, ranges=True)
    r = settled(r.withColumn("raw", F.col(p) / (F.col("below") + F.col("n"))))  # read twice, with the same ranges
    parts = r.groupBy(*keys, "part").agg(F.sum("n").alias("_m"), F.min("raw").alias("_least"))
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    later = F.min("_least").over(every.orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select(*keys, "part", F.sum("_m").over(every).alias("_n"), later.alias("_later"))
    within = F.min("raw").over(Window.partitionBy(*keys, "part").orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0))
    q = r.withColumn("_within", within).join(parts if keys else F.broadcast(parts), [*keys, "part"])
    q = q.select(*keys, p, F.least(F.least("_within", "_later") * F.col("_n"), F.lit(1.0)).alias(out))
    return df.join(q, [*keys, p], "left")


def z_scores(df: DataFrame, value: str, keys: list[str] | None = None, out: str = "z", tol: float = 1e-9) -> DataFrame:
    """(x - mean) / population deviation over finite values; 0 where the deviation is within ``tol`` of 0."""
    keys = keys or []
    s = df.where(finite(F.col(value))).groupBy(*keys).agg(F.avg(value).alias("_mu"), F.stddev_pop(value).alias("_sd"))
    joined = _beside(df, s, keys)
    return joined.withColumn(out, F.when(F.col("_sd") <= tol, 0.0).when(finite(F.col(value)), (F.col(value) - F.col("_mu")) / F.col("_sd"))).drop("_mu", "_sd")


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order`` (which should end in a tie-breaker)."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def top_rows(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def balanced_top(df: DataFrame, category: str, kinds: tuple[str, str], scores: tuple[str, str], tie: Column, total: int) -> DataFrame:
    """At most ``total`` rows of two categories, each by its own score (largest first, then ``tie``).

    Half of them, rounded down, are of the first kind, the others of the second;
    what one can't fill the other takes. A single row goes to the kind whose
    best score is higher, the first one on ties. Without rows of either kind the
    rows of the highest score are taken, and their category is 'blank'.
    """
    tops = [df.where(F.col(category) == k).withColumn("_s", F.col(x)).orderBy(F.desc("_s"), tie).limit(total) for k, x in zip(kinds, scores, strict=True)]
    both = settled(tops[0].unionByName(tops[1]))  # 2 * total rows at most
    n = {r[0]: (r["n"], r["top"]) for r in both.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.max("_s").alias("top")).collect()}
    if not n:
        return df.withColumn("_s", F.greatest(*scores)).orderBy(F.desc("_s"), tie).limit(total).withColumn(category, F.lit("blank")).drop("_s")
    (n1, top1), (n2, top2) = (n.get(k, (0, None)) for k in kinds)
    first = min(n1, total - min(n2, total - total // 2))
    if total == 1 and n1 and n2:
        first = int(top1 >= top2)
    quota = F.when(F.col(category) == kinds[0], first).otherwise(min(n2, total - first))
    return both.withColumn("_r", F.row_number().over(Window.partitionBy(category).orderBy(F.desc("_s"), tie))).where(F.col("_r") <= quota).drop("_r", "_s")


def equal_bins(df: DataFrame, order: list[Column], bins: int, out: str = "bin") -> DataFrame:
    """Bins of equal count, the first ones one larger where it doesn't divide (for short tables, such as a tree's branches)."""
    return df.withColumn(out, F.ntile(bins).over(Window.orderBy(*order)))


def quantile_map(df: DataFrame, x: str, y: str, out: str, keys: list[str] | None = None) -> DataFrame:
    """Maps y on the distribution of x: the quantile (avg_rank(y) - 0.5) / n, interpolated in x, and never below y.

    Only rows in which both are finite rank and count; the others keep their y.
    With ``keys`` each group is a distribution of its own. Sorted positions of x
    come from running counts, and each row asks for the two that enclose its
    quantile by an equi-join on the position's value run.
    """
    keys = keys or []
    df = settled(df.withColumn("_fit", finite(F.col(x)) & finite(F.col(y))))  # read by both rankings
    fit = df.where("_fit")
    runs = running_counts(fit.select(*keys, x), keys, x).withColumnsRenamed({x: "xv", "n": "xn", "below": "xb"})
    n = fit.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    ranked = _beside(average_rank(fit, y, keys, "_r"), n, keys)
    ranked = ranked.withColumn("_pos", (F.col("_n") - 1) * (F.col("_r") - 0.5) / F.col("_n")).withColumn("_lo", F.floor("_pos")).withColumn("_hi", F.ceil("_pos"))
    ranked = settled(ranked)  # read three times below
    points = ranked.select(*keys, F.explode(F.array("_lo", "_hi")).alias("pos")).distinct()
    at = _values_at(runs, points, keys)
    lo, hi = at.select(*keys, F.col("pos").alias("_lo"), F.col("xv").alias("_xlo")), at.select(*keys, F.col("pos").alias("_hi"), F.col("xv").alias("_xhi"))
    mapped = ranked.join(lo, [*keys, "_lo"]).join(hi, [*keys, "_hi"])
    value = F.col("_xlo") + (F.col("_xhi") - F.col("_xlo")) * (F.col("_pos") - F.col("_lo"))
    return mapped.select(*df.columns, F.greatest(F.col(y), value).alias(out)).unionByName(df.where("not _fit").withColumn(out, F.col(y))).drop("_fit")


def exact_quantiles(df: DataFrame, value: str, q: float, keys: list[str] | None = None) -> DataFrame:
    """keys, quantile: the ``q`` quantile of each key's finite values, interpolated; by sorted positions, so no task holds a key's values."""
    keys = keys or []
    rows = settled(df.where(finite(F.col(value))).select(*keys, F.col(value).cast("double").alias("_v")))
    runs = running_counts(rows, keys, "_v").withColumnsRenamed({"_v": "xv", "n": "xn", "below": "xb"})
    n = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 0").withColumn("_pos", (F.col("_n") - 1) * q)
    ends = n.select(*keys, (F.col("_pos") % 1).alias("_part"), F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))).alias("pos"))
    at = _values_at(runs, ends, keys).join(ends, [*keys, "pos"])
    return at.groupBy(*keys).agg((F.min("xv") + (F.max("xv") - F.min("xv")) * F.first("_part")).alias("quantile")).where("quantile is not null")


def _values_at(runs: DataFrame, points: DataFrame, keys: list[str], span: int = 4096) -> DataFrame:
    """Value at sorted positions: runs [below, below + n) are cut at multiples of ``span`` so that both sides equi-join."""
    cut = runs.select(*keys, "xv", "xn", "xb", F.explode(F.sequence(F.floor(F.col("xb") / span), F.floor((F.col("xb") + F.col("xn") - 1) / span))).alias("cell"))
    p = points.withColumn("cell", F.floor(F.col("pos") / span))
    return p.join(cut, [*keys, "cell"]).where("pos >= xb and pos < xb + xn").select(*keys, "pos", "xv")
