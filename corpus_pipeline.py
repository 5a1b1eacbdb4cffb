"""Corpus pipeline: from raw documents to token ids.

Five stages, each one of the operators of the llm subpackage. A stage takes all
that its predecessor kept, and all but the last return the columns of
documents. Between stages the rows lie as Parquet in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladewise.llm import decontaminate, jaccard_join, quality, sentencepiece_viterbi, substring_dedup, toxicity
from cladewise.llm._shared import without, written

#: SQL twin of run(): none, as a trained classifier and a tokenizer are no SQL.
ORACLE_SQL = None


def row_key() -> dict:
    """What tells rows apart: the id and the text's hash."""
    return {"doc_id": F.col("doc_id"), "text_hash": F.xxhash64("text")}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier scores 0.7 or more, learnt from labels outside the held-out fold.

    The text alone decides, so repeated rows stay or go together whatever their
    ids; a null or empty text gets the score of the model's bias. An empty table
    stays empty.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(F.pmod(toxicity.fold(), F.lit(4)) != 2)
    return quality.keep_quality(docs, labels)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates (five-word shingles, similarity 0.8 or more) the document smallest by doc_id and text hash stays.

    Documents without words and those with a null doc_id stay; rows equal in
    doc_id and text are one document and stay or go together; different texts
    of one doc_id are judged apart. An empty table stays empty.
    """
    classes = jaccard_join.jaccard_components(docs, n=5, num=80, den=100)
    return without(docs, classes.where("not leads"), row_key())


def substring_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts word sequences that a document with a smaller id has; a document of which nothing is left goes.

    A text that is cut has its other words joined by one space, and n_chars
    follows; one that isn't is left as it is. Null, empty and blank texts stay;
    a null doc_id counts as the largest; rows of one doc_id don't cut each
    other. An empty table stays empty.
    """
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    out = substring_dedup.dedup_substrings(docs, carry=others)
    out = out.where("n_removed = 0 or n_removed < n_words").withColumn("text", F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))
    columns = {c: F.col(f"carry.{c}") for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more lies in benchmark windows go.

    Documents without words stay; repeated rows stay or go together, different
    texts of one doc_id and rows with a null doc_id are judged apart. Empty
    tables and an empty benchmark change nothing.
    """
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("contaminated")
    return without(docs, found, row_key())


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with the proof that they decode to its text.

    A row for each row; a null text has null ids, an empty one none.
    """
    return sentencepiece_viterbi.encode(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("substring dedup", substring_dedup_stage),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
