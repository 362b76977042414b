"""Tables a run stores between its steps, in the cluster's shared folder."""

import json
from tempfile import mkdtemp
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the checkpoint directory that all executors reach."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors reach")
        base = mkdtemp(prefix="criteria_engine_")
    return f"{base.rstrip('/')}/criteria_engine/{uuid4().hex}"


def store(table: DataFrame, path: str, by=(), **measured: Column) -> tuple[DataFrame, dict]:
    """Write a table, in folders `by` columns, and read it back, which cuts its lineage.

    Also returns its row count `n` and other aggregates, taken while it is written.
    """
    seen = Observation()
    numbers = [F.count(F.lit(1)).alias("n"), *[c.alias(name) for name, c in measured.items()]]
    table.observe(seen, *numbers).write.mode("overwrite").partitionBy(*by).parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path), seen.get


def _place(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(spark: SparkSession, folder: str) -> None:
    """Remove a folder of steps that are over."""
    place, files = _place(spark, folder)
    files.delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _place(spark, path)
    return files.exists(place)


def names(spark: SparkSession, folder: str) -> list[str]:
    """What a folder holds; nothing if there is none."""
    place, files = _place(spark, folder)
    return sorted(found.getPath().getName() for found in files.listStatus(place)) if files.exists(place) else []


def read_record(spark: SparkSession, path: str) -> dict | None:
    """A small file of one JSON object, or None."""
    place, files = _place(spark, path)
    if not files.exists(place):
        return None
    source = files.open(place)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()
    return json.loads(text)


def write_record(spark: SparkSession, path: str, record: dict) -> None:
    """A small JSON file that is there as a whole or not at all; it must not exist yet."""
    place, files = _place(spark, path)
    draft, _ = _place(spark, f"{path}.{uuid4().hex}.draft")
    out = files.create(draft)
    try:
        out.write(json.dumps(record).encode())
    finally:
        out.close()
    if files.exists(place) or not files.rename(draft, place):
        files.delete(draft, False)
        raise FileExistsError(f"another writer wrote {path}")
