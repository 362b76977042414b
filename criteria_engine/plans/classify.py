"""From annotation files to graded models, in one call each.

An output folder holds the attempts log (`attempts`), and per model the current
results (`<model>`) and the rows without a prediction (`error_output_<model>`).
"""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from criteria_engine.fixed_values import MODELS
from criteria_engine.functions.prompts import prompt_preview, user_prompt
from criteria_engine.functions.text import key_hash
from criteria_engine.operators.keyed import (
    SLOT,
    answered_keys,
    current_results,
    dry_run_counts,
    run_summary,
    with_answers,
)
from criteria_engine.operators.lines import first_n
from criteria_engine.operators.metrics import compare_models
from criteria_engine.operators.models import fan_out, select_models
from criteria_engine.operators.scoring import Scorer
from criteria_engine.plans.resume import run_models
from criteria_engine.schemas import ANNOTATION_COLUMNS, KEY, ORDER
from criteria_engine.sinks.exports import write_error_rows, write_results
from criteria_engine.sources.annotations import load_annotations, stage_annotations
from criteria_engine.sources.attempts import read_attempts
from criteria_engine.sources.texts import with_texts
from criteria_engine.storage import discard, shared_folder, store

PREVIEW_ROWS = 3


def attempts_path(output: str) -> str:
    return f"{output}/attempts"


def staged(spark: SparkSession, path, num_rows: int | None, key, folder: str, index: str | None = None) -> DataFrame:
    """The first `num_rows` valid annotations (all for None), stored in `folder` and numbered."""
    loaded = load_annotations(spark, path, num_rows, index)
    return stage_annotations(loaded, f"{folder}/annotations", key)


def classify(
    spark: SparkSession,
    path,
    output: str,
    scorer: Scorer,
    *,
    models: str | None = None,
    num_rows: int | None = None,
    key=KEY,
    registry=MODELS,
    index: str | None = None,
    **options,
) -> DataFrame:
    """Ask the chosen models for what is open, and return the run's summary per model.

    `models` is a comma list, None for all. A repeated call continues where the last
    one stopped and asks failed rows again. `index` is a folder of line counts, which lets a repeated
    `num_rows` read the files of these rows only. `options` go to `run_models`.
    """
    chosen = select_models(models, registry)
    folder = shared_folder(spark)
    try:
        rows = staged(spark, path, num_rows, key, folder, index)
        run_no = run_models(rows, attempts_path(output), scorer, chosen, **options)
        summary = run_summary(rows, read_attempts(spark, attempts_path(output), texts=False), run_no, chosen)
        # a row per model; the stored texts are not needed any more
        return spark.createDataFrame(summary.collect(), summary.schema)
    finally:
        discard(spark, folder)


def dry_run(
    spark: SparkSession,
    path,
    output: str,
    *,
    models: str | None = None,
    num_rows: int | None = None,
    key=KEY,
    registry=MODELS,
    index: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Counts of cached and open rows per model, and a preview of the first rows; asks nothing."""
    chosen = select_models(models, registry)
    loaded = load_annotations(spark, path, num_rows, index).withColumn("key_hash", key_hash(key))
    log = read_attempts(spark, attempts_path(output), texts=False)
    first = load_annotations(spark, path, PREVIEW_ROWS if num_rows is None else min(num_rows, PREVIEW_ROWS), index)
    # PREVIEW_ROWS rows at most
    place = F.row_number().over(Window.orderBy(*ORDER)) - 1
    first = first.select(place.cast("bigint").alias("seq"), key_hash(key).alias("key_hash"), *ANNOTATION_COLUMNS)
    return dry_run_counts(loaded.select("key_hash"), log, chosen), preview(first, log, chosen)


def preview(rows: DataFrame, attempts: DataFrame, models=MODELS) -> DataFrame:
    """First rows in input order with the start of their prompt, per model."""
    # the first places are found without texts; they are PREVIEW_ROWS numbers
    places = [r.seq for r in first_n(rows.select("seq"), PREVIEW_ROWS, ["seq"]).collect()]
    first = fan_out(rows.where(F.col("seq").isin(places)), models)
    # PREVIEW_ROWS x models rows at most: they go to the log, and what they find comes back
    found = attempts.join(F.broadcast(first.select(*SLOT)), SLOT, "left_semi")
    done = answered_keys(found).withColumn("_done", F.lit(True))
    return first.join(F.broadcast(done), SLOT, "left").select(
        "seq",
        "model",
        "drug_name",
        "section",
        "label",
        F.col("_done").isNotNull().alias("cached"),
        prompt_preview(user_prompt()).alias("preview"),
    )


def compare(spark: SparkSession, output: str, registry=MODELS) -> DataFrame:
    """Grade everything that is stored, for all registered models."""
    stored = current_results(read_attempts(spark, attempts_path(output), texts=False))
    return compare_models(with_answers(stored), registry)


def export(spark: SparkSession, output: str, models=None) -> None:
    """Write the current results and error rows of each model in the log (or of `models`) as CSV."""
    log = read_attempts(spark, attempts_path(output), texts=False)
    folder = shared_folder(spark)
    current = with_texts(spark, attempts_path(output), current_results(log))
    stored, _ = store(current, folder, by=["model"])
    try:
        found = [r.model for r in log.select("model").distinct().collect()]
        for name in found if models is None else [name for name, _ in models]:
            write_results(stored, output, name)
            write_error_rows(stored, output, name)
    finally:
        discard(spark, folder)
