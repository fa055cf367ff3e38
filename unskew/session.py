"""Brings this package to the Python workers of a session, wherever they run."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.abspath(__file__))


def ship(spark: SparkSession) -> SparkSession:
    """Once for each Spark context: adds the package's sources as a Python file that executors fetch."""
    sc = spark.sparkContext
    if not getattr(sc, "_unskew_shipped", False):
        path = os.path.join(tempfile.mkdtemp(prefix="unskew-"), "unskew_sources.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, files in os.walk(ROOT):
                for f in sorted(files):
                    if f.endswith(".py"):
                        full = os.path.join(folder, f)
                        z.write(full, os.path.join("unskew", os.path.relpath(full, ROOT)))
        sc.addPyFile(path)
        sc._unskew_shipped = True
    return spark
