"""Prepare a Spark session for the package."""

import shutil
from functools import cache
from pathlib import Path
from tempfile import mkdtemp

from pyspark.sql import SparkSession

PACKAGE = Path(__file__).resolve().parent


@cache
def _archive() -> str:
    target = Path(mkdtemp(prefix="criteria_engine_")) / "criteria_engine"
    return shutil.make_archive(str(target), "zip", PACKAGE.parent, PACKAGE.name)


def ship_package(spark: SparkSession) -> SparkSession:
    """Make the package importable in Python workers that do not have it installed."""
    context = spark.sparkContext
    if not any(name.endswith("/criteria_engine.zip") for name in context.listFiles):
        context.addPyFile(_archive())
    return spark
