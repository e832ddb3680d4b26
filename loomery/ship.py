"""Sends this package to the executors where they can't be expected to import it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_sent: set[str] = set()


def ensure(spark: SparkSession) -> None:
    """Add the package as a zip to the application, once; not where PYTHONPATH or the working folder already names its place."""
    places = [*os.environ.get("PYTHONPATH", "").split(os.pathsep), os.getcwd()]
    context = spark.sparkContext
    if context.applicationId in _sent or any(p and Path(p).resolve() == ROOT for p in places):
        return
    path = Path(tempfile.mkdtemp()) / "loomery.zip"  # on the driver only; Spark hands it out
    with zipfile.ZipFile(path, "w") as z:
        for file in sorted((ROOT / "loomery").rglob("*.py")):
            z.write(file, file.relative_to(ROOT))
    context.addPyFile(str(path))
    _sent.add(context.applicationId)
