"""Hits of protein searches in BLAST's XML2 reports, by Spark's XML reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The parts of a hit that are read; a hit without descriptions may hold their fields itself.
_FIELDS = "id string, accession string, title string"
HIT = f"description struct<HitDescr: array<struct<{_FIELDS.replace(' string', ': string')}>>>, {_FIELDS}"


def _trimmed(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """file, rank (from 1), accession, title of the reports' hits, in their order, each accession once a file.

    A hit's first description counts. Without an accession it is what stands
    between bars in the identifier, or the first word of it, or of the title; a
    version behind a dot is cut off; hits without any are left out. The title is
    identifier and title, or the accession. Fails on malformed reports.
    """
    raw = spark.read.format("xml").option("rowTag", "Hit").option("ignoreNamespace", True).option("mode", "FAILFAST").schema(HIT).load(path)
    raw = raw.select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("_at"))
    first = F.get("description.HitDescr", F.lit(0))
    part = lambda name: _trimmed(F.when(first.isNotNull(), first[name]).otherwise(F.col(name)))
    h = raw.select("file", "_at", part("id").alias("id"), part("accession").alias("accession"), part("title").alias("title"))
    named = F.when(F.col("id") != "", F.col("id")).otherwise(F.col("title"))
    bars = F.regexp_extract(named, r"\|([^|]+)\|", 1)
    own = F.when(F.col("accession") != "", F.col("accession")).when(bars != "", bars).otherwise(F.get(F.split(named, r"\s+"), F.lit(0)))
    h = h.withColumn("accession", F.trim(F.regexp_replace(own, r"\..*", ""))).where("accession <> ''")
    shown = F.trim(F.concat_ws(" ", "id", "title"))
    best = h.groupBy("file", "accession").agg(F.min(F.struct("_at", F.when(shown != "", shown).otherwise(F.col("accession")).alias("title"))).alias("h"))
    order = Window.partitionBy("file").orderBy("h._at")  # a report's hits are a few hundred
    return best.select("file", F.row_number().over(order).alias("rank"), "accession", F.col("h.title").alias("title"))
