"""Tables that several later plans read: computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """The frame checkpointed in the shared folder that spark.checkpoint.dir names; cached where none is set.

    Either way a lost executor costs time only: a checkpoint lies in the shared
    folder, and a cached partition is computed anew from its lineage.
    """
    if df.sparkSession.conf.get("spark.checkpoint.dir", None):
        return df.checkpoint()
    return df.cache()
