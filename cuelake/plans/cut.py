"""Cutting long plans at a durable copy."""

import tempfile

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """Folder that all executors share, as the session names it."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Checkpoint to the shared folder of the session.

    Used where later steps read the rows several times and would repeat costly
    work (grouped folds, model calls).  The copy lies in ``spark.checkpoint.dir``,
    so it outlives lost executors.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()
