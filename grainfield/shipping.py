"""The package for executors that don't share the driver's folders."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package to the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="grainfield-ship-"), "grainfield.zip")  # Spark sends it from here
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in sorted(os.walk(os.path.join(_ROOT, "grainfield"))):
            for name in sorted(names):
                if name.endswith(".py"):
                    z.write(os.path.join(folder, name), os.path.relpath(os.path.join(folder, name), _ROOT))
    context.addPyFile(path)
    _sent.add(context.applicationId)


def shipped(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run
