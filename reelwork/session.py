"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def find_package(spark: SparkSession) -> None:
    """Let Python workers find this package where it isn't installed but on their machine too, as in local mode."""
    environment = spark.sparkContext.environment
    root = str(Path(__file__).resolve().parent.parent)
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])


def arrow_map(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow, with this package on the workers' path."""
    find_package(df.sparkSession)
    return df.mapInArrow(run, schema)
