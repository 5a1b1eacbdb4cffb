"""FASTA as a source and a sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.sequence import IUPAC


def read_fasta(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """seq_id, description, sequence of each record; plain or gzipped. Fails on blank headers when the rows are used.

    A record starts at a '>' at the beginning of a line. With ``key`` (seq_id or
    description) the rows also fail where two records agree in it.
    """
    # a record's text runs to the next line break and '>'; the first one still has its own '>'
    r = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", r"\A\s*>", "").alias("value")).where("trim(value) <> ''")
    head = F.trim(F.regexp_extract("value", r"\A([^\r\n]*)", 1))
    body = F.regexp_replace(F.regexp_replace("value", r"\A[^\r\n]*", ""), r"\s+", "")
    r = r.select(head.alias("description"), body.alias("sequence"))
    r = r.select(F.when(F.col("description") == "", F.raise_error(F.lit("blank FASTA header"))).otherwise(F.split("description", r"\s+")[0]).alias("seq_id"), "description", "sequence")
    if key is None:
        return r
    twice = r.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    same = F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicate FASTA header: "), F.col(key))).cast("string")).otherwise(F.col(key))
    return r.join(twice, key).select(*[(same if c == key else F.col(c)).alias(c) for c in r.columns])


def duplicate_ids(records: DataFrame, key: str = "seq_id") -> DataFrame:
    return records.groupBy(key).count().where("count > 1")


def write_fasta(records: DataFrame, path: str, width: int = 60) -> None:
    """Records as text files, sequences wrapped at ``width``."""
    wrapped = F.regexp_replace("sequence", f"(.{{{width}}})(?=.)", "$1\n")
    records.select(F.concat(F.lit(">"), "description", F.lit("\n"), wrapped).alias("value")).write.text(path)


def residues(records: DataFrame) -> DataFrame:
    """seq_id, site, codon: one row for each codon of aligned coding sequences."""
    n = F.floor(F.length("sequence") / 3).cast("int")
    r = records.where(n > 0).select("seq_id", "sequence", F.explode(F.sequence(F.lit(0), n - 1)).alias("site"))
    return r.select("seq_id", "site", F.upper(F.substring("sequence", F.col("site") * 3 + 1, F.lit(3))).alias("codon"))


def unknown_letters(records: DataFrame) -> DataFrame:
    """Letters per record that are neither nucleotides, ambiguity codes nor gaps."""
    known = "".join(IUPAC) + "U-?."
    letter = F.explode(F.split(F.upper("sequence"), ""))
    return records.select("seq_id", letter.alias("letter")).where(~F.col("letter").isin(list(known)) & (F.col("letter") != "")).groupBy("seq_id", "letter").count()
