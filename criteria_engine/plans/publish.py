"""Exports that appear as a whole: every folder of one is written first, then one record names it.

    <base>/<id>/...              one export: result and error CSVs, and what else was asked for
    <base>/<version>.json        the export that this version is, and its models

Readers go by the newest record. An export that breaks off has no record and is removed by the next
one; the export before the newest is kept, for readers that began with it. One writer per base.
"""

from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import SparkSession, functions as F

from criteria_engine.fixed_values import MODELS
from criteria_engine.operators.keyed import current_results, with_answers
from criteria_engine.operators.metrics import classification_metrics
from criteria_engine.sinks import exports
from criteria_engine.sources.attempts import read_attempts
from criteria_engine.sources.texts import with_texts
from criteria_engine.storage import discard, names, read_record, shared_folder, store, write_record

# Exports that stay: the newest, and the one before it.
KEPT = 2


def _versions(spark: SparkSession, base: str) -> list[str]:
    return [name for name in names(spark, base) if name.endswith(".json")]


def published(spark: SparkSession, base: str) -> str | None:
    """Folder of the newest whole export, or None."""
    found = _versions(spark, base)
    return f"{base}/{read_record(spark, f'{base}/{found[-1]}')['folder']}" if found else None


def publish(
    spark: SparkSession, log_path: str, base: str, models: Sequence[str] | None = None, run_ts: str | None = None, registry=MODELS
) -> str:
    """Export the log's current results of each model in it, or of `models`; returns the export's folder.

    It holds `<model>` and `error_output_<model>`; with `run_ts` also predictions and metrics of each
    model in `<model>_<run_ts>`, and the comparison of the registered ones. All of it is of one state of the log, which
    is read once. A model without results has empty CSVs and no metrics.
    """
    scratch, name = shared_folder(spark), uuid4().hex
    folder = f"{base}/{name}"
    log = read_attempts(spark, log_path, texts=False)
    if models is not None and run_ts is None:  # a comparison is of all models
        log = log.where(F.col("model").isin(*models))
    try:
        current, _ = store(with_texts(spark, log_path, current_results(log)), scratch, by=["model"])
        found = sorted(r.model for r in current.select("model").distinct().collect())  # a row per model
        chosen = found if models is None else list(models)
        for model in chosen:
            exports.write_results(current, folder, model)
            exports.write_error_rows(current, folder, model)
        if run_ts is not None:
            answered = with_answers(current)
            graded = classification_metrics(answered)
            for model in chosen:
                exports.write_predictions(answered, folder, model, run_ts)
                if model in found:
                    exports.write_metrics(graded, folder, model, run_ts)
            exports.write_comparison(graded, folder, registry)
    finally:
        discard(spark, scratch)
    _appear(spark, base, {"folder": name, "models": chosen, "run_ts": run_ts})
    return folder


def _appear(spark: SparkSession, base: str, record: dict) -> None:
    before = _versions(spark, base)
    version = int(before[-1].removesuffix(".json")) + 1 if before else 1
    write_record(spark, f"{base}/{version:08}.json", record)
    kept = _versions(spark, base)[-KEPT:]
    held = {*kept, *(read_record(spark, f"{base}/{name}")["folder"] for name in kept)}
    for name in names(spark, base):
        if name not in held:
            discard(spark, f"{base}/{name}")
