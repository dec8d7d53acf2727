"""Frames written down so that steps that follow read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Used only where a local session names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints/cartulary"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, of spark.checkpoint.dir; a cluster must name it."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set; it names the folder that driver and executors share")
        context.setCheckpointDir(LOCAL_CHECKPOINTS)
    return context.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """The rows of ``df``, written to the shared folder and read from there: what made them is not run again, and the
    loss of an executor loses none."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
