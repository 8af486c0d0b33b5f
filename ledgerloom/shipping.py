"""Sends this package to the executors, for sessions that don't have it on their path."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent
_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package as a zip to the session's Python files, once an application."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    path = os.path.join(tempfile.mkdtemp(prefix="ledgerloom-"), f"{ROOT.name}.zip")
    with zipfile.ZipFile(path, "w") as out:
        for file in sorted(ROOT.rglob("*.py")):
            out.write(file, file.relative_to(ROOT.parent))
    context.addPyFile(path)
    _sent.add(context.applicationId)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``query`` with the package on the executors before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
