"""Where intermediate rows are kept, so that what is used again is not made again, nor lost with an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only where it names none and all runs on one machine, a temporary one."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(found or tempfile.mkdtemp(prefix="tessella-"))
    return spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()


def settled(df: DataFrame) -> DataFrame:
    """df, checkpointed in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
