"""Bounds of the Arrow batches that Python workers get.

A batch is whole in the worker's memory, once as Arrow and often once more as Python objects. By Spark's defaults it
grows with the rows of a task up to 10,000, however long they are.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Bounds of an Arrow batch. JVM and Python worker hold one each per task.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch bounds where they are higher, so that long texts don't fill the workers' memory."""
    rows, size = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < int(spark.conf.get(rows)) <= BATCH_ROWS:
        spark.conf.set(rows, BATCH_ROWS)
    now = spark.conf.get(size)
    if not (now.rstrip("b").isdigit() and 0 < int(now.rstrip("b")) <= BATCH_BYTES):
        spark.conf.set(size, f"{BATCH_BYTES}b")


def bound_active() -> None:
    """``bound_batches`` of the thread's active session, for functions that only see columns."""
    if (spark := SparkSession.getActiveSession()) is not None:
        bound_batches(spark)
