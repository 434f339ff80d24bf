"""Writing an intermediate result to the shared folder, so that it is neither computed again nor lost."""

from __future__ import annotations

from pyspark.sql import DataFrame


def saved(df: DataFrame) -> DataFrame:
    """``df`` read back from the cluster's checkpoint folder (``spark.checkpoint.dir``), which must be set."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder)
    return df.checkpoint()
