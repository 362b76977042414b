"""The attempts log as folders: appended runs, and segments into which runs are merged.

    runs/run_no=R/try_no=T/model=M/      answers as they come
    segments/<id>/bucket=B/model=M/      one row per (model, key) of some runs
    fresh/, texts/                       sentences (`sources/texts.py`); attempts hold their digests
    manifests/<version>.json             the segments that hold, and the last run they cover

A merge reads the runs behind the last covered one, and those segments that are not much
larger than they are; it writes a new segment and then the next manifest. Readers go by the
newest manifest: before it is written the new segment counts for nothing, after it the merged
runs do. So a merge that breaks off anywhere changes no result. A key's current result is the
first valid attempt, else the last one, and can be taken of parts first: results are
those of the whole log. Segments grow geometrically, so a row is rewritten a number of
times that grows with the logarithm of the log, and there are about as many segments.

Rows of a segment lie in buckets by the first bits of their key's digest. A run over few keys
reads the buckets of their digests and the runs that are not merged yet.

A try is what one start of a run wrote. A run that is started again under its number leaves
its earlier tries' valid answers and takes back their failures, since those rows are asked again.
"""

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from criteria_engine.operators.keyed import current_results
from criteria_engine.schemas import LOGGED
from criteria_engine.sources.manifests import (
    BUCKET_ROWS,
    PREFIX_BITS,
    digest_prefix,
    manifest,
    prefixes,
    read_buckets,
    write_buckets,
)
from criteria_engine.sources.texts import merge_texts, sweep_texts
from criteria_engine.storage import discard, names, write_record

# Runs behind the last merge at which the next one is due.
MERGE_RUNS = 8
# A segment is merged again once what joins it has this part of its rows.
GROWTH = 2


def _numbers(spark: SparkSession, folder: str, key: str) -> list[int]:
    return sorted(int(name.removeprefix(f"{key}=")) for name in names(spark, folder) if name.startswith(f"{key}="))


def stored_runs(spark: SparkSession, path: str) -> list[int]:
    return _numbers(spark, f"{path}/runs", "run_no")


def stored_tries(spark: SparkSession, path: str, run_no: int) -> list[int]:
    return _numbers(spark, f"{path}/runs/run_no={run_no}", "try_no")


def last_run(spark: SparkSession, path: str) -> int:
    """The last run's number, 0 without any, by the folders' names."""
    return max([manifest(spark, path)["merged"], *stored_runs(spark, path)])


def key_prefix(bits: int = PREFIX_BITS) -> Column:
    """The first bits of the key's digest, as a number."""
    return digest_prefix("key_hash", bits)


def _schema(*keys: str) -> T.StructType:
    fields = [f for f in LOGGED.fields if f.name not in keys]
    return T.StructType([*fields, *[T.StructField(k, T.IntegerType()) for k in keys]])


def no_attempts(spark: SparkSession) -> DataFrame:
    # a filter that never holds is planned away, and joins with it too
    none = [F.lit(None).cast(field.dataType).alias(field.name) for field in LOGGED]
    return spark.range(1).where(F.lit(False)).select(*none)


def read_runs(spark: SparkSession, path: str, runs: list[int]) -> DataFrame:
    """All that counts of some runs; only their folders are listed."""
    if not runs:
        return no_attempts(spark)
    folders = [f"{path}/runs/run_no={n}" for n in runs]
    read = spark.read.schema(_schema("run_no", "try_no")).option("basePath", f"{path}/runs").parquet(*folders)
    for n in runs:
        *_, last = stored_tries(spark, path, n)
        if last:
            read = read.where((F.col("run_no") != n) | (F.col("try_no") == last) | F.col("answered"))
    return read.select(*LOGGED.names)


def _segment(spark: SparkSession, path: str, segment: dict, wanted: set[int] | None = None) -> DataFrame:
    return read_buckets(spark, f"{path}/segments/{segment['name']}", LOGGED, segment["bits"], wanted).select(*LOGGED.names)


def read_log(spark: SparkSession, path: str, near: DataFrame | None = None) -> DataFrame:
    """The log, one row per (model, key) of merged runs and all attempts of later ones.

    With `near`, rows whose `key_hash` starts like none of its rows' may be left out: buckets
    without them are not read. It is read for that only if a segment has several buckets; its
    prefixes are 4,096 numbers at most.
    """
    state = manifest(spark, path)
    wanted = None
    if near is not None and any(s["bits"] for s in state["segments"]):
        wanted = prefixes(near, "key_hash")
    parts = [_segment(spark, path, s, wanted) for s in state["segments"]]
    later = [n for n in stored_runs(spark, path) if n > state["merged"]]
    if later:
        parts.append(read_runs(spark, path, later))
    return reduce(DataFrame.unionByName, parts) if parts else no_attempts(spark)


def compact(spark: SparkSession, path: str, runs: int = MERGE_RUNS, bucket_rows: int = BUCKET_ROWS) -> bool:
    """Merge the runs behind the last merge if there are as many as `runs`; returns whether it did.

    One writer at a time. Folders that the manifest before the last merge named are kept until
    the next merge, for readers that started by it.
    """
    state = manifest(spark, path)
    later = [n for n in stored_runs(spark, path) if n > state["merged"]]
    if not later or len(later) < runs:
        return False
    parts = [read_runs(spark, path, later)]
    rows, kept = parts[0].count(), list(state["segments"])
    while kept and kept[-1]["rows"] <= GROWTH * rows:
        rows += kept[-1]["rows"]
        parts.append(_segment(spark, path, kept.pop()))
    name = uuid4().hex
    merged = current_results(reduce(DataFrame.unionByName, parts))
    bits = write_buckets(merged, f"{path}/segments/{name}", "key_hash", rows, bucket_rows, ["model"])
    size = spark.read.parquet(f"{path}/segments/{name}").count()
    new = {
        "version": state["version"] + 1,
        "merged": later[-1],
        "segments": [*kept, {"name": name, "rows": size, "bits": bits}],
        **merge_texts(spark, path, state, GROWTH, bucket_rows),
    }
    write_record(spark, f"{path}/manifests/{new['version']:08}.json", new)
    _sweep(spark, path, state, new)
    return True


def _sweep(spark: SparkSession, path: str, before: dict, now: dict) -> None:
    """Remove what neither manifest names, and the manifests before them."""
    named = {s["name"] for state in (before, now) for s in state["segments"]}
    for name in names(spark, f"{path}/segments"):
        if name not in named:
            discard(spark, f"{path}/segments/{name}")
    for n in stored_runs(spark, path):
        if n <= before["merged"]:
            discard(spark, f"{path}/runs/run_no={n}")
    for name in names(spark, f"{path}/manifests"):
        if name.split(".")[0] < f"{before['version']:08}":
            discard(spark, f"{path}/manifests/{name}")
    sweep_texts(spark, path, before, now)
