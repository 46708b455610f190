"""Shared pieces of the training-data operators: Arrow access, scratch tables, hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ..batches import bound_batches  # noqa: F401  for the operators
from ..checkpoints import base_folder

#: Rows of a batch are handed to numpy in runs of about this many bytes, so that scratch arrays stay small.
RUN_BYTES = 1 << 20


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder; see ``checkpoints.base_folder``."""
    return f"{base_folder(spark)}/qf-{uuid.uuid4().hex}"


def fresh_names(taken: Iterable[str], *names: str) -> list[str]:
    """Column names like ``names`` that no column in ``taken`` has, whatever its case."""
    there, out = {x.lower() for x in taken}, []
    for name in names:
        while name.lower() in there:
            name += "_"
        there.add(name.lower())
        out.append(name)
    return out


class Scratch:
    """Written tables that cut lineage: lost executors re-read files, nothing is recomputed.

    Results read them lazily, so they stay when an operator returns; the folder belongs to whoever owns
    the checkpoint folder.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.base, self.n = spark, scratch_dir(spark), 0
        self.there: dict[str, DataFrame] = {}

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        self.there[path] = out
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for df in tables:
            if self.there.pop(df.scratch_path, None) is not None:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(df.scratch_path)
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Delete all tables but those that the result reads."""
        kept = {df.scratch_path for df in tables}
        self.drop(*[df for path, df in self.there.items() if path not in kept])


def utf8_view(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them, without copying; nulls are empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def runs(offsets: np.ndarray, most: int = RUN_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``most`` bytes; a longer row is a range of its own."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = j
