"""Recoded amino-acid classes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Published classes of amino acids. Dayhoff classes: Dayhoff, Schwartz and Orcutt 1978 and their finer
#: divisions in Feuda et al. 2017; SR: Susko and Roger 2007; KGB: Kosiol, Goldman and Buttimore 2004.
SCHEMES = {
    "none": ["A", "C", "D", "E", "F", "G", "H", "I", "K", "L", "M", "N", "P", "Q", "R", "S", "T", "V", "W", "Y"],
    "dayhoff6": ["AGPST", "DENQ", "HKR", "ILMV", "FWY", "C"],
    "sr6": ["APST", "DENG", "QKR", "MIVL", "WC", "FYH"],
    "kgb6": ["AGPS", "DENQHKRT", "MIL", "W", "FY", "CV"],
    "sr4": ["AGNPST", "CHWY", "DEKQR", "FILMV"],
    "dayhoff9": ["DEHNQ", "ILMV", "FY", "AST", "KR", "G", "P", "C", "W"],
    "dayhoff12": ["DEQ", "MLIV", "FY", "KHR", "G", "A", "P", "S", "T", "N", "W", "C"],
    "dayhoff15": ["DEQ", "ML", "IV", "FY", "G", "A", "P", "S", "T", "N", "K", "H", "R", "W", "C"],
    "dayhoff18": ["ML", "FY", "I", "V", "G", "A", "P", "S", "T", "D", "E", "Q", "N", "H", "K", "R", "W", "C"],
}
#: Other names of schemes, after '-' and '_' are taken out.
ALIASES = {"no": "none", "d6": "dayhoff6"}


def classes(scheme: str) -> dict[str, str]:
    """Amino acid to the class it is in; the class is named by its members."""
    name = scheme.strip().lower().replace("-", "").replace("_", "")
    groups = SCHEMES.get(ALIASES.get(name, name))
    if groups is None:
        raise ValueError(f"unknown scheme {scheme!r}")
    return {aa: g for g in groups for aa in g}


def recode(posterior: DataFrame, scheme: str) -> DataFrame:
    """Sums amino-acid posteriors (node, site, state, p) over the classes of a scheme."""
    of = F.create_map(*[F.lit(x) for pair in classes(scheme).items() for x in pair])
    return posterior.withColumn("state", of[F.col("state")]).where("state is not null").groupBy("node", "site", "state").agg(F.sum("p").alias("p"))
