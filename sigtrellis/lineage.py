"""Tables between the rounds of a loop."""

from __future__ import annotations

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """df, computed now and cut from the plan that made it: in the folder of spark.checkpoint.dir, or with the executors where that is unset."""
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()
