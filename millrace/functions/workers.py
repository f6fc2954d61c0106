"""Python workers must be able to import this package."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession


def on_workers(spark: SparkSession) -> None:
    """Puts the package's folder on the path of Python workers started on this machine; on a
    cluster the package is installed or sent with --py-files, and this changes nothing."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH")) if x)
