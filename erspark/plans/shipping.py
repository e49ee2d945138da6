"""Making the package importable in Python workers that don't share the driver's ``sys.path``."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def importable(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path. On a cluster without a shared file system, ship the package
    with ``--py-files`` instead; then the entry added here is simply absent there."""
    paths = [p for p in spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
