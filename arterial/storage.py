"""Cutting lineage on storage that every executor reaches."""

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where a session names none, a folder of its own if all runs in one process, as in tests; else an error."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not (context.master.startswith("local") and not context.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="arterial-"))
    return context._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """df computed once and kept in the checkpoint folder: losing an executor loses nothing.

    Spark deletes a checkpoint that nothing refers to any more if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()
