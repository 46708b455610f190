"""Readers: papers, JSON lines, JSON documents, runs and usage logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_blank, markdown_title
from ..operators.dataset import union_runs
from .schemas import QA_FIELDS, USAGE, schema


def read_papers(spark: SparkSession, folder: str, limit: int | None = None) -> DataFrame:
    """Markdown files of a folder, by path: paper_id, title, text, source_path.

    Files that aren't UTF-8 or are blank are left out, and don't count for the limit. A missing folder
    fails. Names that start with ``_`` or ``.`` aren't seen by Spark.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    good = files.where(F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.col("content").cast("string").alias("text")).where(~is_blank(F.col("text")))
    if limit is not None:
        good = good.orderBy("path").limit(limit)
    stem = F.regexp_replace(F.url_decode(F.substring_index("path", "/", -1)), r"\.md$", "")
    return good.select(stem.alias("paper_id"), markdown_title(F.col("text"), stem).alias("title"), "text", F.col("path").alias("source_path"))


def read_jsonl(spark: SparkSession, path: str | Sequence[str], ddl: str) -> DataFrame:
    """JSON lines of a fixed schema; a broken line fails the job, blank lines are skipped."""
    return spark.read.schema(schema(ddl)).option("mode", "FAILFAST").json(path if isinstance(path, str) else list(path))


def read_json_document(spark: SparkSession, path: str, ddl: str = QA_FIELDS) -> DataFrame:
    """One JSON document: an object or an array of objects."""
    return spark.read.schema(schema(ddl)).option("mode", "FAILFAST").option("multiLine", True).json(path)


def read_runs(spark: SparkSession, folders: Sequence[str], name: str = "final_qa.jsonl", ddl: str = QA_FIELDS) -> DataFrame:
    """One file of each run with run_ord and line_ord, in the order given; a run without it fails."""
    runs = [read_jsonl(spark, f"{f.rstrip('/')}/{name}", ddl).withColumn("line_ord", F.monotonically_increasing_id()) for f in folders]
    return union_runs(runs)


def read_usage(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Usage logs of several processes as one table; absent counts are null."""
    return read_jsonl(spark, paths, USAGE)
