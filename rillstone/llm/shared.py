"""What the operators share: intermediate tables in the folder that driver and executors see, and the size of Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_TABLES: list[str] = []
"""Tables that :func:`written` has left, in the order they were made."""
BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def folder(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``, which must be set."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if context.getCheckpointDir() is None:
        if named is None:
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        context.setCheckpointDir(named)
    return named or context.getCheckpointDir()


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python in Arrow batches of about ``BATCH_BYTES``, unless the session has a limit of its own.

    By rows alone (10 000) a batch of documents has tens of MB, and each task holds several times that in the JVM's buffers, which
    stay with the executor, and in Python. The setting stays, since results are computed later; they do not depend on it.
    """
    if spark.conf.get(BATCH_LIMIT, None) is None:
        spark.conf.set(BATCH_LIMIT, str(BATCH_BYTES))


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once; its lineage ends here.

    Spark drops the files when nothing refers to them if ``spark.cleaner.referenceTracking.cleanCheckpoints`` is true; else they
    stay until the folder is emptied.
    """
    folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table of its own, whose size the planner knows. It stays until :func:`scope` or :func:`clear`."""
    path = f"{folder(df.sparkSession).rstrip('/')}/tables/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _TABLES.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    jvm = spark._jvm
    for name in paths:
        path = jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession, since: int = 0) -> int:
    """Deletes the tables that this process has written, once the results that read them are written themselves."""
    paths = _TABLES[since:]
    _delete(spark, paths)
    del _TABLES[since:]
    return len(paths)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables that are written inside are deleted at its end, also after an error. Write the result elsewhere inside it."""
    since = len(_TABLES)
    try:
        yield
    finally:
        clear(spark, since)
