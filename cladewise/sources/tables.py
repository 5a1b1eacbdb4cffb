"""Text tables: ancestral states, site rates, foreground files, TSV output."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_states(spark: SparkSession, path: str, nodes: list[str] | None = None) -> DataFrame:
    """node, site (from 0), state, p of a table with columns Node, Site, State and p_<state>; only the given nodes, if any.

    The filter on Node stands before the unpivot, so other nodes' lines are dropped as they are read.
    """
    t = spark.read.option("comment", "#").option("sep", "\t").option("header", True).csv(path)
    states = [c for c in t.columns if c.startswith("p_")]
    if not states or not {"Node", "Site"} <= set(t.columns):
        raise ValueError("a state table needs Node, Site and p_ columns")
    if nodes is not None:
        t = t.where(F.col("Node").isin(nodes))
    t = t.select("Node", (F.col("Site").cast("int") - 1).alias("site"), *[F.col(c).cast("double") for c in states])
    return t.unpivot(["Node", "site"], states, "state", "p").select(F.col("Node").alias("node"), "site", F.substring("state", 3, 10).alias("state"), "p").where("p > 0")


def state_problems(states: DataFrame, expected_sites: int) -> DataFrame:
    """Nodes whose sites aren't 0 .. expected_sites - 1, each once per state."""
    d = states.groupBy("node", "site", "state").agg(F.count(F.lit(1)).alias("k"))
    g = d.groupBy("node").agg(F.count_distinct("site").alias("n"), F.min("site").alias("low"), F.max("site").alias("high"), F.max("k").alias("k"))
    return g.where((F.col("n") != expected_sites) | (F.col("low") != 0) | (F.col("high") != expected_sites - 1) | (F.col("k") > 1))


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """site (from 0) and rate; column Rate, or C_Rate where there is none. Fails unless the sites are 1 to n, each once."""
    t = spark.read.option("comment", "#").option("sep", "\t").option("header", True).csv(path)
    column = "Rate" if "Rate" in t.columns else "C_Rate"
    t = t.select((F.col("Site").cast("int") - 1).alias("site"), F.col(column).cast("double").alias("rate"))
    n, distinct, low, high = t.agg(F.count(F.lit(1)), F.count_distinct("site"), F.min("site"), F.max("site")).first()
    if n and (n != distinct or low != 0 or high != n - 1):
        raise ValueError("the sites of a rate table must be 1 to n, each once")
    return t


def read_foreground(spark: SparkSession, path: str) -> DataFrame:
    """trait, lineage, pattern of a file without header (lineage, pattern), or of one with a header and a column per trait."""
    raw = spark.read.option("comment", "#").option("sep", "\t").csv(path).where("_c0 is not null")
    first = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).first()
    if first is None or not re.match(r"name\t", first[0]):
        return raw.select(F.lit("trait").alias("trait"), F.col("_c0").alias("lineage"), F.col("_c1").alias("pattern"))
    t = spark.read.option("comment", "#").option("sep", "\t").option("header", True).csv(path)
    from ..operators.traits import background_value

    long = t.unpivot(["name"], [c for c in t.columns if c != "name"], "trait", "lineage")
    return long.where(~background_value(F.col("lineage"))).select("trait", "lineage", F.col("name").alias("pattern"))


def write_tsv(df: DataFrame, path: str, decimals: int = 4, append: bool = False) -> None:
    """Tab-separated text with header; doubles with ``decimals`` places, NaN and null empty.

    Columns that end in _sub, 2any or 2spe are written as whole numbers if all
    their values are whole. ``append`` adds files to those that are there.
    """
    counts = [c for c, kind in df.dtypes if kind in ("double", "float") and c.endswith(("_sub", "2any", "2spe"))]
    if counts:
        broken = df.agg(*[F.count_if(F.isnan(f"`{c}`") | F.col(f"`{c}`").isNull() | (F.col(f"`{c}`") % 1 != 0)).alias(c) for c in counts]).first()
        df = df.withColumns({c: F.col(f"`{c}`").cast("long") for c in counts if not broken[c]})
    out = []
    for c, kind in df.dtypes:
        v = F.col(f"`{c}`")
        if kind in ("double", "float"):
            v = F.when(v.isNull() | F.isnan(v), "").otherwise(F.format_string(f"%.{decimals}f", v.cast("double")))
        elif kind == "boolean":
            v = F.when(v, "Y").otherwise("N")
        elif kind.startswith("array"):
            v = F.array_join(v.cast("array<string>"), ",")
        out.append(F.coalesce(v.cast("string"), F.lit("")).alias(c))
    df.select(*out).write.mode("append" if append else "errorifexists").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
