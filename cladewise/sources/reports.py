"""Reports of phylogenetic programs: models, frequencies, logs, exchangeabilities, coordinate maps. Small files, read as text by Spark."""

from __future__ import annotations

import math
import re
from itertools import product

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import BASES, genetic_code


def _text(spark: SparkSession, path: str) -> str:
    """A report of a few thousand lines."""
    return spark.read.text(path, wholetext=True).first()[0].replace("\r", "")


def _number(text: str, label: str) -> float | None:
    found = re.findall(rf"^\s*{re.escape(label)}\s*:\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)", text, re.M)
    return float(found[-1]) if found else None


def read_report(spark: SparkSession, path: str, codons: list[str] | None = None) -> dict:
    """version, major, model and, with ``codons``, their frequencies (summing to 1) of a program report.

    Both notations of frequencies are read, pi(AAA) and pi( AAA ), plain or with
    an exponent; of a codon named twice the first counts. Fails without a model
    or without a frequency for each codon.
    """
    text = _text(spark, path)
    version = re.search(r"IQ-TREE(?:(?: multicore)? version)?\s+([0-9]+(?:\.[0-9]+)*)", text)
    model = re.search(r"^\s*Model of substitution:\s*(.+?)\s*$", text, re.M)
    if not model:
        raise ValueError("the report names no substitution model")
    out = {"version": version and version[1], "major": int(version[1].split(".")[0]) if version else None, "model": model[1]}
    if codons is not None:
        out["frequencies"] = _frequencies(text, codons)
    return out


def _frequencies(text: str, codons: list[str]) -> np.ndarray:
    found: dict[str, float] = {}
    for codon, value in re.findall(r"pi\(\s*([A-Z]+)\s*\)\s*=\s*([-+]?\d*\.?\d+(?:[eE][-+]?\d+)?)", text):
        found.setdefault(codon.replace("U", "T"), float(value))
    missing = [c for c in codons if not math.isfinite(found.get(c, math.nan))]
    if missing:
        raise ValueError(f"no frequency of {', '.join(missing[:10])}")
    f = np.array([found[c] for c in codons])
    if not f.sum() > 0:
        raise ValueError("the frequencies sum to nothing")
    return f / f.sum()


def read_log(spark: SparkSession, path: str) -> dict:
    """omega, kappa and the genetic code's number of a log; None for what it doesn't say, the last line for what it says twice."""
    text = _text(spark, path)
    code = re.findall(r"^\s*Converting to codon sequences with genetic code\s+([0-9]+)\s*\.\.\.", text, re.M)
    return {"omega": _number(text, "Nonsynonymous/synonymous ratio (omega)"), "kappa": _number(text, "Transition/transversion ratio (kappa)"), "genetic_code": int(code[-1]) if code else None}


def exchange_codons() -> list[str]:
    """Sense codons of the standard code in the order of exchangeability files."""
    code = genetic_code(1)
    return [c for c in map("".join, product(BASES, repeat=3)) if code[c] != "*"]


def read_exchangeabilities(spark: SparkSession, path: str, codons: list[str] | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """Symmetric matrix and frequencies of a codon model file, in the order of ``codons``.

    The lower triangle fills the first 60 lines (1,830 numbers), the
    frequencies line 62.
    """
    order = exchange_codons()
    codons = codons or order
    if sorted(codons) != sorted(order):
        raise ValueError("a codon model file is for the sense codons of the standard code, each once")
    lines = _text(spark, path).split("\n")
    values = np.array([float(x) for line in lines[:60] for x in line.split()])
    if len(values) != 1830:
        raise ValueError(f"{len(values)} exchangeabilities instead of 1830")
    m = np.zeros((61, 61))
    m[np.tril_indices(61, -1)] = values
    at = [order.index(c) for c in codons]
    frequencies = np.array([float(x) for x in lines[61].split()]) if len(lines) > 61 else None
    if frequencies is None or len(frequencies) != 61:
        raise ValueError("line 62 should have 61 frequencies")
    return (m + m.T)[np.ix_(at, at)], frequencies[at]


def codon_rates(codons: list[str], frequencies: np.ndarray, omega: float | None = None, kappa: float | None = None, ncbi_id: int = 1) -> np.ndarray:
    """Mechanistic codon rates: single changes only, times omega if the amino acid changes and kappa for transitions, scaled to one change per unit time."""
    if omega is not None and omega < 0:
        raise ValueError("omega is below 0")
    code, n = genetic_code(ncbi_id), len(codons)
    letters = np.array([list(c) for c in codons])
    differ = letters[:, None, :] != letters[None, :, :]
    q = (differ.sum(axis=2) == 1).astype(float)
    purine = np.isin(letters, ["A", "G"])
    same_kind = (purine[:, None, :] == purine[None, :, :]) | ~differ
    aa = np.array([code[c] for c in codons])
    if omega is not None:
        q *= np.where(aa[:, None] != aa[None, :], omega, 1.0)
    if kappa is not None:
        q *= np.where(same_kind.all(axis=2), kappa, 1.0)
    q = q * np.asarray(frequencies)[None, :]
    np.fill_diagonal(q, 0)
    scale = float(np.asarray(frequencies) @ q.sum(axis=1))
    q /= scale if scale > 0 else 1.0
    q[np.arange(n), np.arange(n)] = -q.sum(axis=1)
    return q


def read_coordinate_map(spark: SparkSession, path: str) -> DataFrame:
    """seq_id, site (of the alignment, from 1), gene_site and residue of a map with a '>' line for each sequence and lines 'residue, own site, alignment site'.

    Lines that start with '#' and those that have no alignment site ('' or '-')
    are left out; an own site of that kind is 0, without residue. Fails on other
    sites that are no whole numbers when the rows are used.
    """
    # a record for each sequence, split at '>' lines by the reader
    r = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"\A\s*>", "").alias("v")).where("trim(v) <> ''")
    lines = r.select(F.trim(F.regexp_extract("v", r"\A([^\r\n]*)", 1)).alias("seq_id"), F.explode(F.split(F.regexp_replace("v", r"\A[^\r\n]*", ""), r"\r?\n")).alias("line"))
    cells = lines.where("trim(line) <> '' and not startswith(line, '#')").select("seq_id", F.split("line", ",").alias("c"))
    cells = cells.select("seq_id", *[F.trim(F.get("c", F.lit(i))).alias(n) for i, n in enumerate(("residue", "own", "aln"))]).where("aln is not null and aln not in ('', '-')")
    whole = lambda c: F.when(F.col(c).rlike(r"\A[0-9]+\z"), F.col(c).cast("int")).otherwise(F.raise_error(F.concat(F.lit("no site: "), F.col(c))).cast("int"))
    own = F.when(F.coalesce(F.col("own"), F.lit("")).isin("", "-"), F.lit(0)).otherwise(whole("own"))
    rows = cells.select("seq_id", whole("aln").alias("site"), own.alias("gene_site"), "residue")
    return rows.withColumn("residue", F.when(F.col("gene_site") == 0, "").otherwise(F.col("residue")))


def read_site_degrees(spark: SparkSession, path: str, sites: int) -> DataFrame:
    """site (from 0), degree: mean over the lines of each site of a table with columns site and degree; 0 for sites without one."""
    t = spark.read.option("sep", "\t").option("comment", "#").option("header", True).csv(path)
    d = t.groupBy((F.col("site").cast("int") - 1).alias("site")).agg(F.avg(F.col("degree").cast("double")).alias("degree"))
    axis = spark.range(sites).select(F.col("id").cast("int").alias("site"))
    return axis.join(d, "site", "left").fillna(0.0, ["degree"])


