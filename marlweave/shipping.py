"""Sends the package to the Python workers, wherever the driver found it."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

HERE = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> None:
    """Adds the package's code to the session once; workers need not have it installed."""
    context = spark.sparkContext
    if getattr(context, "_has_marlweave", False) or not os.path.isdir(HERE):
        return
    # the driver serves this file to its executors; it holds code only
    path = os.path.join(tempfile.mkdtemp(prefix="marlweave-code-"), "marlweave.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(HERE):
            for name in files:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("marlweave", os.path.relpath(full, HERE)))
    context.addPyFile(path)
    context._has_marlweave = True


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
