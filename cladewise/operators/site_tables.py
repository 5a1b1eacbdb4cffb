"""Tables with a row for each site and what is joined to them: statistics, states, gene and structure numbering, distances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..plans.settled import settled

#: The reference's hydrophobicity of the amino acids (empirical, PLoS ONE 8:e80635).
HYDROPHOBICITY = {"A": 129.0, "R": 274.0, "N": 195.0, "D": 193.0, "C": 167.0, "E": 223.0, "Q": 225.0, "G": 104.0, "H": 224.0, "I": 197.0, "L": 201.0, "K": 236.0, "M": 224.0, "F": 240.0, "P": 159.0, "S": 155.0, "T": 172.0, "W": 285.0, "Y": 263.0, "V": 174.0}


def add_site_stats(sites: DataFrame, stats: DataFrame, suffix: str = "") -> DataFrame:
    """Site table with the statistics of its sites (inner join; columns but site get the suffix)."""
    return sites.join(stats.withColumnsRenamed({c: f"{c}{suffix}" for c in stats.columns if c != "site"}), "site")


def add_states(sites: DataFrame, states: DataFrame, branches: list[int]) -> DataFrame:
    """state_<id> and hydrophobicity_<id> of each branch: its likeliest amino acid at the site (branch_id, site, state); '' and null without one."""
    wide = states.where(F.col("branch_id").isin(branches)).groupBy("site").agg(*[F.max(F.when(F.col("branch_id") == b, F.col("state"))).alias(f"state_{b}") for b in branches])
    scale = F.create_map(*[F.lit(x) for kv in HYDROPHOBICITY.items() for x in kv])
    out = sites.join(wide, "site", "left")
    out = out.withColumns({f"hydrophobicity_{b}": F.try_element_at(scale, F.col(f"state_{b}")) for b in branches})
    return out.fillna("", [f"state_{b}" for b in branches])


def gene_index(residues: DataFrame, gap: str = "-") -> DataFrame:
    """seq_id, site, gene_site: position (from 1) of each residue in its sequence without gaps, from (seq_id, site, residue)."""
    w = Window.partitionBy("seq_id").orderBy("site")
    return residues.where(F.col("residue") != gap).select("seq_id", "site", F.row_number().over(w).alias("gene_site"))


def add_gene_index(sites: DataFrame, index: DataFrame, seq_id: str) -> DataFrame:
    """gene_site_<seq_id>: the sequence's own position at each alignment site, 0 in gaps."""
    own = index.where(F.col("seq_id") == seq_id).select("site", F.col("gene_site").alias(f"gene_site_{seq_id}"))
    return sites.join(own, "site", "left").fillna(0, [f"gene_site_{seq_id}"])


def add_residue_numbers(sites: DataFrame, numbering: DataFrame, position: str, out: str = "residue_number") -> DataFrame:
    """Structure residue numbers by position in the structure's sequence: numbering (position, number); null where there is none."""
    return sites.join(numbering.select(F.col("position").alias(position), F.col("number").alias(out)).dropDuplicates([position]), position, "left")


def add_coordinates(events: DataFrame, coordinates: DataFrame) -> DataFrame:
    """x, y, z of each event's site; of several coordinates of a site the one of the smallest (x, y, z) counts."""
    one = coordinates.groupBy("site").agg(F.min(F.struct("x", "y", "z")).alias("_c")).select("site", "_c.x", "_c.y", "_c.z")
    return events.join(one, "site", "left")


def patterns_with_distances(totals: DataFrame, distances: DataFrame) -> DataFrame:
    """(grp, a, d) totals of changes with the largest distance between branches that have them."""
    return totals.join(distances, ["grp", "a", "d"])


def row_numbers(df: DataFrame, order: list, out: str = "number") -> DataFrame:
    """Numbers rows from 0 in a global order without a global window: ranges are sorted apart and their sizes added up."""
    spread = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_i", F.monotonically_increasing_id()))
    part, within = F.shiftright("_i", 33), F.col("_i").bitwiseAND(F.lit((1 << 33) - 1))
    spread = spread.withColumns({"_part": part, "_at": within})
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    offsets = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    return spread.join(F.broadcast(offsets), "_part").withColumn(out, F.col("_before") + F.col("_at")).drop("_i", "_part", "_at", "_before")


def substitution_patterns(cb: DataFrame, columns: list[str], key: list[str], out: str) -> DataFrame:
    """Adds the number of each row's pattern: its members' values in ascending order; patterns are numbered by their first row's key."""
    sorted_ = cb.withColumn("_pattern", F.array_sort(F.array(*columns)))
    first = sorted_.groupBy("_pattern").agg(F.min(F.struct(*key)).alias("_first"))
    return sorted_.join(row_numbers(first, ["_first"], out).drop("_first"), "_pattern").drop("_pattern")


def strongest_sites(sites: DataFrame, columns: list[str], least: float, most: int) -> DataFrame:
    """site, score of the sites where some column reaches ``least``: the ``most`` of highest score, ties to the smaller site."""
    score = F.greatest(*[F.coalesce(F.when(~F.isnan(c), F.col(c)), F.lit(0.0)) for c in columns], F.lit(0.0))
    return sites.select("site", score.alias("score")).where(F.col("score") >= least).orderBy(F.desc("score"), "site").limit(most)


def set_sites(sites: DataFrame, member: str, probability: str, most: int) -> DataFrame:
    """site, score of the members of a set whose probability is above 0, strongest first."""
    return sites.where(F.col(member) & (F.col(probability) > 0)).select("site", F.col(probability).alias("score")).orderBy(F.desc("score"), "site").limit(most)


def best_structures(structures: DataFrame, key: str, criteria: list[str]) -> DataFrame:
    """The structure of each key that is largest by the criteria in their order; NaN and null count as least."""
    least = F.lit(float("-inf"))
    rank = F.struct(*[F.coalesce(F.when(~F.isnan(c), F.col(c).cast("double")), least).alias(c) for c in criteria], F.col("structure_id"))
    return structures.groupBy(key).agg(F.max_by("structure_id", rank).alias("structure_id"))


def representative_leaves(leaves: DataFrame) -> DataFrame:
    """clade, leaf: the one at place n // 2 of a clade's leaves sorted by length without gaps (clade, leaf, sequence), ties to the smaller name."""
    length = F.length(F.regexp_replace("sequence", "-", ""))
    w = Window.partitionBy("clade")
    ranked = leaves.select("clade", "leaf", (F.row_number().over(w.orderBy(length, "leaf")) - 1).alias("_r"), F.count(F.lit(1)).over(w).alias("_n"))
    return ranked.where("_r = floor(_n / 2)").select("clade", "leaf")


def variant_scores(events: DataFrame, scores: DataFrame, mode: str = "most_deleterious") -> DataFrame:
    """site, score, branch_id of the variant scores of a site's events: branch_id, site, a, d, pp and site, a, d, score.

    most_deleterious: the least score and its branch (then the likelier event,
    then the smaller branch); mean: of the events; pp_weighted_mean: weighted by
    pp, or the mean where the weights sum to nothing.
    """
    j = events.join(scores, ["site", "a", "d"]).where(F.col("score").isNotNull() & ~F.isnan("score"))
    if mode == "most_deleterious":
        return j.groupBy("site").agg(F.min(F.struct("score", (-F.col("pp")).alias("p"), "branch_id")).alias("m")).select("site", "m.score", "m.branch_id")
    value = F.avg("score") if mode == "mean" else F.when(F.sum("pp") > 0, F.sum(F.col("score") * F.col("pp")) / F.sum("pp")).otherwise(F.avg("score"))
    return j.groupBy("site").agg(value.alias("score")).withColumn("branch_id", F.lit(None).cast("int"))
