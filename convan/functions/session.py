"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers on this machine import this package, wherever the driver was started.

    On a cluster whose machines don't share this folder, ship the package with --py-files."""
    path = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in path.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, path]))
    return spark
