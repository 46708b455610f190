"""Written tables between the steps of a loop.

A step's result is written before anything reads it, so a lost executor re-reads files. The folder is
below the checkpoint folder that all executors share.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def base_folder(spark: SparkSession) -> str:
    """The shared folder for written tables.

    It is the session's ``spark.checkpoint.dir``, or what ``SparkContext.setCheckpointDir`` was given. Where
    neither is set, local mode takes the warehouse folder, as its threads share one disk; on a cluster
    that is an error, since other machines wouldn't see the files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


class Checkpoints:
    def __init__(self, spark: SparkSession):
        self.spark, self.base = spark, f"{base_folder(spark)}/qf-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
