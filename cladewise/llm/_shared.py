"""Tables in the shared folder, and components of a link table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; only where that is unset (tests, one machine), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        root = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tables-{uuid.uuid4().hex}"


def written_at(df: DataFrame) -> tuple[DataFrame, str]:
    """The frame as a Parquet table in the shared folder, and where it lies: cuts its lineage and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame) -> DataFrame:
    return written_at(df)[0]


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a table of written_at that no frame reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Rows of ids that are broadcast at most; more are joined by a shuffle.
BROADCAST_IDS = 100_000


def without(docs: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Rows of ``docs`` whose ``keys`` (expressions over docs, by a column of ``gone``) aren't in ``gone``; null equals null.

    ``gone`` is broadcast if it is short.
    """
    taken = {c.lower() for c in docs.columns}
    names = {k: next(n for n in (f"gone{'_' * i}_{k}" for i in range(len(taken) + 1)) if n.lower() not in taken) for k in keys}
    gone = written(gone.select(*[F.col(k).alias(n) for k, n in names.items()]).distinct())
    small = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return docs.join(small, [x.eqNullSafe(F.col(names[k])) for k, x in keys.items()], "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (a, b).

    Rounds of least-neighbour labels with pointer jumping; each is written to
    the shared folder, after which the former one is deleted, and only a count
    comes back to the driver.
    """
    both, edge_path = written_at(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels, path = written_at(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        stepped = labels.join(near, labels.node == near.a).select("node", F.least("component", "near").alias("up"), F.col("component").alias("was"))
        hop = labels.select(F.col("node").alias("up"), F.col("component").alias("top"))
        new, new_path = written_at(stepped.join(hop, "up").select("node", F.least("up", "top").alias("component"), (F.least("up", "top") < F.col("was")).alias("changed")))
        removed(edges.sparkSession, path)
        labels, path = new.select("node", "component"), new_path
        if not new.where("changed").limit(1).count():
            removed(edges.sparkSession, edge_path)
            return labels
