"""Streams over growing folders: usage totals as logs arrive, and new papers handed to the loop.

The reference semantics have no event time; these only run the batch operators on what is new.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.schemas import USAGE, schema


def usage_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Running totals by role of JSON lines files as they appear in a folder."""
    calls = spark.readStream.schema(schema(USAGE)).json(folder)
    tokens = ("prompt_tokens", "completion_tokens", "reasoning_tokens", "cached_tokens")
    return calls.groupBy("role").agg(
        F.count(F.lit(1)).alias("calls"), F.count_if("usage_missing").alias("usage_missing"), F.sum("latency_s").alias("latency_s"),
        *[F.sum(F.coalesce(F.col(t), F.lit(0))).alias(t) for t in tokens],
    )


def each_batch(papers: DataFrame, step: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """``step`` on every micro-batch of new papers; a batch that runs again gets the same number."""
    writer = papers.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
