"""Make this package importable in Python workers, wherever the driver imported it from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_DONE = "_quillforge_shipped"


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once per Spark application."""
    context = spark.sparkContext
    if getattr(context, _DONE, False):
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp()) / "quillforge.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent).as_posix())
    context.addPyFile(str(target))
    setattr(context, _DONE, True)
