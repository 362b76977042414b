"""Grades that follow the log run by run.

After each run the table of confusion counts per model is kept with the keys that have no valid
answer yet. The next run's part of the log is all that is read of the log to bring both up to
date: the run's current rows are counted, and of keys that had failed before, the failure is
taken back. Valid answers are final, so they are never taken back.

    grades/<run>.json            the folder, and how often the run had been started
    grades/<id>/cells            counts per model after the run
    grades/<id>/failing          (model, key_hash) without a valid answer after the run
"""

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from criteria_engine.operators.keyed import SLOT, current_results, with_answers
from criteria_engine.operators.metrics import CELLS, COUNTS, classification_counts, with_ratios
from criteria_engine.sources.attempts import read_attempts
from criteria_engine.sources.segments import last_run, manifest, read_runs, stored_runs, stored_tries
from criteria_engine.storage import discard, names, read_record, store, write_record

NUMBERS = (*CELLS, *COUNTS)


def _graded(spark: SparkSession, path: str) -> dict[int, dict]:
    """Records of graded runs that still hold: the run has not been started again since."""
    found = [int(n.removesuffix(".json")) for n in names(spark, f"{path}/grades") if n.endswith(".json")]
    records = {run: read_record(spark, f"{path}/grades/{run}.json") for run in sorted(found)}
    return {run: r for run, r in records.items() if len(stored_tries(spark, path, run)) <= r["tries"]}


def _counted(current: DataFrame) -> DataFrame:
    return classification_counts(with_answers(current)).select("model", *NUMBERS)


def _put(spark: SparkSession, path: str, run: int, cells: DataFrame, failing: DataFrame) -> dict:
    name = uuid4().hex
    store(cells, f"{path}/grades/{name}/cells")
    store(failing, f"{path}/grades/{name}/failing")
    record = {"folder": name, "tries": len(stored_tries(spark, path, run))}
    discard(spark, f"{path}/grades/{run}.json")  # of a run that was started again
    write_record(spark, f"{path}/grades/{run}.json", record)
    return record


def _read(spark: SparkSession, path: str, record: dict) -> tuple[DataFrame, DataFrame]:
    folder = f"{path}/grades/{record['folder']}"
    numbers = ", ".join(f"{n} bigint" for n in NUMBERS)
    cells = spark.read.schema(f"model string, {numbers}").parquet(f"{folder}/cells")
    return cells, spark.read.schema("model string, key_hash binary").parquet(f"{folder}/failing")


def after_run(spark: SparkSession, path: str, run: int, cells: DataFrame, failing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and failing keys after `run`, from those before it and the run's part of the log."""
    current = current_results(read_runs(spark, path, [run]))
    # keys of the run whose earlier failure no longer counts: a row in `total` and one in `errors`
    asked = current.select(*SLOT)
    taken_back = failing.join(asked, SLOT, "left_semi").groupBy("model").agg(F.count("*").alias("n"))
    minus = taken_back.select("model", *[(-F.col("n") if c in ("total", "errors") else F.lit(0)).cast("long").alias(c) for c in NUMBERS])
    parts = [cells, _counted(current), minus]
    summed = reduce(DataFrame.unionByName, parts).groupBy("model").agg(*[F.sum(c).alias(c) for c in NUMBERS])
    still = failing.join(asked, SLOT, "left_anti").unionByName(current.where(~F.col("answered")).select(*SLOT))
    return summed, still


def grade(spark: SparkSession, path: str) -> DataFrame:
    """`classification_metrics` of the log's current results, per model, brought up to its last run.

    Runs are those of `run_models`, which asks no key again that has a valid answer. The log is read
    as a whole only where no grades are stored yet, or where runs were merged that had not been
    graded. A call that breaks off leaves the grades of the runs before. Without any run there are no rows.
    """
    last, graded = last_run(spark, path), _graded(spark, path)
    if last not in graded:
        known = max(graded, default=0)
        later = [run for run in stored_runs(spark, path) if run > known]
        if graded and manifest(spark, path)["merged"] <= known:
            for run in later:
                graded[run] = _put(spark, path, run, *after_run(spark, path, run, *_read(spark, path, graded[known])))
                known = run
        else:
            current = current_results(read_attempts(spark, path, texts=False))
            failing = current.where(~F.col("answered")).select(*SLOT)
            graded[last] = _put(spark, path, last, _counted(current), failing)
        _forget(spark, path, sorted(graded)[-2:])
    return with_ratios(_read(spark, path, graded[last])[0])


def _forget(spark: SparkSession, path: str, runs: list[int]) -> None:
    """Keep the grades of these runs only: the last, and the one before it in case the last is started again."""
    held = {f"{run}.json" for run in runs}
    folders = {read_record(spark, f"{path}/grades/{name}")["folder"] for name in held}
    for name in names(spark, f"{path}/grades"):
        if name not in held | folders:
            discard(spark, f"{path}/grades/{name}")
