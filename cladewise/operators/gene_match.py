"""Positions of an alignment's sites in the untrimmed genes, by windows of decreasing size.

Sites and gene codons that can be the same meet by sequence and codon; runs along
a diagonal (gene site minus alignment site) tell every window that matches, of
any size. What remains is one choice after another along a sequence, and is made
within the sequence's own rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.ancestral import first_states

#: Sizes of the windows, the largest first.
WINDOWS = (100, 50, 10, 5, 4, 3, 2, 1)


def gene_codons(genes: DataFrame, ncbi_id: int = 1) -> DataFrame:
    """seq_id, gene_site, gene_sites, state of coding sequences (seq_id, sequence) without their gaps; an ambiguous codon is the first it can be, stops have no row.

    Fails on a length that isn't a multiple of three when the rows are used.
    """
    text = F.regexp_replace(F.upper("sequence"), "-", "")
    g = genes.select("seq_id", text.alias("text"))
    n = F.when(F.length("text") % 3 == 0, (F.length("text") / 3).cast("int")).otherwise(F.raise_error(F.concat(F.lit("length of a coding sequence must be a multiple of three: "), F.col("seq_id"))).cast("int"))
    each = g.withColumn("gene_sites", n).where("gene_sites > 0").select("seq_id", "gene_sites", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("gene_sites") - 1), lambda i: F.substring("text", i * 3 + 1, 3))).alias("gene_site", "codon"))
    return each.join(F.broadcast(first_states(genes.sparkSession, ncbi_id)), "codon").select("seq_id", "gene_site", "gene_sites", "state")


def matching_runs(tips: DataFrame, codons: DataFrame) -> DataFrame:
    """seq_id, site, gene_site, gene_sites, length: pairs of sites that can be the same, and how long their diagonal goes on to match from there."""
    pairs = tips.select("seq_id", "site", "state").join(codons, ["seq_id", "state"]).select("seq_id", "site", "gene_site", "gene_sites").distinct()
    diagonal = Window.partitionBy("seq_id", "_d").orderBy("site")
    run = pairs.withColumn("_d", F.col("gene_site") - F.col("site")).withColumn("_run", F.col("site") - F.row_number().over(diagonal))
    last = F.max("site").over(Window.partitionBy("seq_id", "_d", "_run"))
    return run.withColumn("length", last - F.col("site") + 1).drop("_d", "_run")


def choose_windows(at: dict[int, list[tuple[int, int]]], sites: int, gene_sites: int, windows=WINDOWS) -> np.ndarray:
    """Gene site of each site, or -1. ``at``: for a site its (gene site, length of the run) in ascending order.

    For each window size, from the largest, the sites that are still open are
    tried in order, those a fifth of a window or more behind the one before;
    a window's gene sites must be open or within a window's length before a run
    of open ones, and end no later than what follows on the alignment.
    """
    out = np.full(sites, -1, np.int64)
    for size in (w for w in windows if w < gene_sites and w < sites):
        open_, step = np.flatnonzero(out == -1), max(size // 5, 1)
        free = np.ones(gene_sites, bool)
        free[out[out != -1]] = False
        able = free.copy()
        for first in [g for i, g in enumerate(np.flatnonzero(free)) if i and not free[g - 1]]:
            able[max(first - size, 0) : first] = True
        for k, site in enumerate(open_):
            if k and site < open_[k - 1] + step:
                continue
            if site + size > sites:
                break
            for gene_site, length in at.get(int(site), ()):
                if length < size or not able[gene_site]:
                    continue
                after = out[site + size - 1 :]
                after = after[after != -1]
                if len(after) and after.min() < gene_site + size - 1:
                    continue
                out[site : site + size] = np.arange(gene_site, gene_site + size)
                break
    return out


def match_genes(tips: DataFrame, genes: DataFrame, sites: int, ncbi_id: int = 1) -> DataFrame:
    """seq_id, site, gene_site (both from 0) of the sites that are found in the sequence's own gene.

    tips: states of the aligned sequences (seq_id, site, state), of ``sites``
    sites; genes: seq_id, sequence, untrimmed. A task holds the pairs of sites
    of one sequence that share a codon.
    """
    kind = tips.schema["seq_id"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        at: dict[int, list] = {}
        for site, gene_site, length in pdf.sort_values(["site", "gene_site"])[["site", "gene_site", "length"]].itertuples(index=False):
            at.setdefault(int(site), []).append((int(gene_site), int(length)))
        found = choose_windows(at, sites, int(pdf.gene_sites.iloc[0]))
        on = np.flatnonzero(found >= 0)
        return pd.DataFrame({"seq_id": pdf.seq_id.iloc[0], "site": on.astype(np.int32), "gene_site": found[on].astype(np.int32)})

    return matching_runs(tips, gene_codons(genes, ncbi_id)).groupBy("seq_id").applyInPandas(run, f"seq_id {kind}, site int, gene_site int")
