"""Which branches a site table is made for, and the columns of a set expression."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import set_expression
from . import permute


@dataclass(frozen=True)
class Mode:
    """kind: intersection, lineage or set; the statistic ('any', 'spe') and expression are of sets."""

    kind: str
    stat: str | None = None
    expression: str | None = None


def parse_mode(text: str) -> Mode:
    """'intersection', 'lineage' or 'set,<any or spe>,<expression>'."""
    parts = [p.strip() for p in text.split(",")]
    kind = parts[0].lower()
    if kind == "set":
        if len(parts) != 3 or parts[1].lower() not in ("any", "spe") or not parts[2]:
            raise ValueError("a set is written as set,any,1|5 or set,spe,1|5")
        nothing = set_expression.Value(F.lit(False), F.lit(0.0))
        set_expression.compile_expression(parts[2], {b: nothing for b in set_expression.branches(parts[2])}, nothing)
        return Mode(kind, parts[1].lower(), parts[2])
    if kind not in ("intersection", "lineage"):
        raise ValueError(f"unknown mode {text!r}")
    return Mode(kind)


def parse_branches(text: str) -> list[int]:
    """Different whole numbers, separated by commas, in their order."""
    try:
        ids = [int(p) for p in text.split(",") if p.strip()]
    except ValueError:
        raise ValueError(f"branches are whole numbers: {text!r}") from None
    if not ids or len(set(ids)) < len(ids):
        raise ValueError(f"no branch, or one twice: {text!r}")
    return ids


def foreground_combinations(cb: DataFrame) -> DataFrame:
    """branch_ids (sorted, each once) of the rows of a cb table in which any column is_fg* is true or says so (Y, yes, true, t, 1)."""
    members = [c for c in cb.columns if c.startswith("branch_id_")]
    flags = [c for c in cb.columns if c.startswith("is_fg")]
    if not members or not flags:
        raise ValueError("a cb table needs columns branch_id_* and is_fg*")
    said = F.lit(False)
    for c in flags:
        said = said | F.coalesce(F.lower(F.trim(F.col(c).cast("string"))).isin("y", "yes", "true", "t", "1"), F.lit(False))
    ids = F.array_sort(F.array_distinct(F.filter(F.array(*[F.col(c).cast("int") for c in members]), lambda b: b.isNotNull())))
    return cb.where(said).select(ids.alias("branch_ids"))


def site_jobs(mode: Mode, nodes: DataFrame, branches: str = "", cb: DataFrame | None = None, ancestors: DataFrame | None = None) -> DataFrame:
    """branch_ids, single: the jobs of a mode, one a row.

    nodes: node, parent (null for the root). 'intersection': the given branches,
    or with 'fg' the foreground combinations of ``cb``; 'lineage': all branches
    from below the first given node down to the second, by ``ancestors`` (node,
    ancestor, depth); 'set': the branches that the expression names, without the
    root. Fails on nodes that aren't there, on the root as a branch, and without
    any branch.
    """
    spark = nodes.sparkSession
    root = {r.node for r in nodes.where("parent is null").select("node").collect()}

    def known(ids: list[int]) -> list[int]:
        there = {r.node for r in nodes.where(F.col("node").isin(ids)).select("node").collect()}
        if set(ids) - there:
            raise ValueError(f"no such nodes: {sorted(set(ids) - there)}")
        return ids

    def job(ids: list[int]) -> DataFrame:
        if not ids:
            raise ValueError("no branch is left")
        return spark.createDataFrame([(sorted(set(ids)),)], "branch_ids array<int>")

    if mode.kind == "set":
        out = job([b for b in known(set_expression.branches(mode.expression)) if b not in root])
    elif mode.kind == "lineage":
        ends = known(parse_branches(branches))
        if len(ends) != 2 or ends[1] in root:
            raise ValueError("a lineage has two ends, and the lower one isn't the root")
        out = job([r.branch_id for r in permute.lineage_path(ancestors, *ends).collect()])
    elif branches.strip().lower() == "fg":
        out = foreground_combinations(cb)
        odd = out.select(F.explode("branch_ids").alias("node")).distinct().join(nodes.where("parent is not null").select("node"), "node", "left_anti")
        if not out.limit(1).count() or odd.limit(1).count():
            raise ValueError("no foreground combination, or one with a branch that isn't there")
    else:
        ids = known(parse_branches(branches))
        if root & set(ids):
            raise ValueError("the root is no branch")
        out = job(ids)
    return out.select("branch_ids", (F.size("branch_ids") == 1).alias("single"))


def set_columns(sites: DataFrame, events: DataFrame, mode: Mode, least: float, silent: DataFrame | None = None) -> DataFrame:
    """The columns of a set expression for each of ``sites`` (site): N_set_branch_<b>_prob, N_set_expr, N_set_expr_prob, N_set_expr_channel and, if A is in it, N_set_other, N_set_other_prob and S_set_other_prob.

    A channel is a derived state ('spe') or all of them ('any'). The expression
    is judged in each channel, a branch being in it with ``least`` of its
    probability; a site is in the set if it is so in any channel, and the
    likeliest one is named (ties: the smaller state; '' without any). A is the
    largest value of the other branches; ``silent`` are their synonymous events.
    """
    named = set_expression.branches(mode.expression)
    channel = F.lit("any") if mode.stat == "any" else F.col("d").cast("string")
    v = events.groupBy("site", channel.alias("channel"), "branch_id").agg(F.sum(F.nanvl(F.col("pp"), F.lit(0.0))).alias("v"))
    own = [F.coalesce(F.sum(F.when(F.col("branch_id") == b, F.col("v"))), F.lit(0.0)).alias(f"v{b}") for b in named]
    other = F.coalesce(F.max(F.when(~F.col("branch_id").isin(named), F.col("v"))), F.lit(0.0)).alias("va")
    wide = v.groupBy("site", "channel").agg(*own, other)
    value = lambda c: set_expression.Value(F.col(c) >= least, F.col(c))
    result = set_expression.compile_expression(mode.expression, {b: value(f"v{b}") for b in named}, value("va"))
    wide = wide.withColumns({"_in": result.member, "_p": result.probability})
    best = F.min(F.when(F.col("_p") > 0, F.struct((-F.col("_p")).alias("p"), F.col("channel").alias("c"))))
    cols = [F.least(F.max(f"v{b}"), F.lit(1.0)).alias(f"N_set_branch_{b}_prob") for b in named]
    cols += [F.bool_or("_in").alias("N_set_expr"), F.max("_p").alias("N_set_expr_prob"), best.alias("_best"), F.bool_or(F.col("va") >= least).alias("N_set_other"), F.max("va").alias("N_set_other_prob")]
    g = wide.groupBy("site").agg(*cols).withColumn("N_set_expr_channel", F.coalesce("_best.c", F.lit(""))).drop("_best")
    with_other = "A" in set_expression.tokens(mode.expression)
    if not with_other:
        g = g.drop("N_set_other", "N_set_other_prob")
    out = sites.select("site").join(g, "site", "left")
    if with_other:
        s = None if silent is None else silent.where(~F.col("branch_id").isin(named)).groupBy("site", "branch_id").agg(F.sum("pp").alias("s")).groupBy("site").agg(F.max("s").alias("S_set_other_prob"))
        out = out.withColumn("S_set_other_prob", F.lit(0.0)) if s is None else out.join(s, "site", "left")
    numbers = [c for c in out.columns if c.endswith("_prob")]
    return out.fillna(0.0, numbers).fillna(False, [c for c in ("N_set_expr", "N_set_other") if c in out.columns]).fillna("", ["N_set_expr_channel"])


def site_index_map(kept: DataFrame, sites: int) -> DataFrame:
    """codon_site_alignment, codon_site_alignment_1based, site, site_1based, is_retained: where each of the alignment's sites is among those kept (site, new)."""
    axis = kept.sparkSession.range(sites).select(F.col("id").alias("codon_site_alignment"))
    j = axis.join(kept.select(F.col("site").cast("long").alias("codon_site_alignment"), F.col("new").cast("long").alias("site")), "codon_site_alignment", "left").fillna(-1, ["site"])
    return j.select("codon_site_alignment", (F.col("codon_site_alignment") + 1).alias("codon_site_alignment_1based"), "site", (F.col("site") + 1).alias("site_1based"), F.when(F.col("site") >= 0, "Y").otherwise("N").alias("is_retained"))


def score_sites(events: DataFrame, most: int) -> DataFrame:
    """site: the ``most`` sites of the least finite score (site, score, pp), then of the largest pp, then the first."""
    known = events.where(F.col("score").isNotNull() & ~F.isnan("score") & (F.abs("score") < float("inf")))
    g = known.groupBy("site").agg(F.min("score").alias("s"), F.max("pp").alias("p"))
    return g.orderBy("s", F.desc("p"), "site").limit(most).select("site").orderBy("site")
