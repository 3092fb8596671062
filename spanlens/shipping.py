"""Giving this package to the Python workers of a cluster."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Add the package to every executor's Python path, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        with tempfile.TemporaryDirectory() as at:
            shutil.copytree(package, f"{at}/zip/{os.path.basename(package)}", ignore=shutil.ignore_patterns("__pycache__"))
            # Stays until the process ends: executors that start later fetch it too.
            file = shutil.make_archive(f"{tempfile.mkdtemp()}/{os.path.basename(package)}", "zip", f"{at}/zip")
        sc.addPyFile(file)
        _shipped.add(sc.applicationId)
