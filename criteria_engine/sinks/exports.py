"""Files for people and other tools. The attempts log itself is `append_attempts`."""

from pyspark.sql import DataFrame, functions as F, types as T

from criteria_engine.fixed_values import MODELS
from criteria_engine.functions.responses import correct
from criteria_engine.operators.keyed import error_rows, result_rows
from criteria_engine.operators.metrics import RATIOS, rounded_metrics
from criteria_engine.schemas import ANNOTATION_COLUMNS, RESULT_COLUMNS

PREDICTION_COLUMNS = (
    "drug_name",
    "trial_id",
    "section",
    "label",
    "prediction",
    "correct",
    "raw_response",
    "error",
    "criteria_text",
)


def _write_csv(table: DataFrame, path: str) -> None:
    """CSV with a header, doubled quotes, and texts kept as they are."""
    table.write.mode("overwrite").options(
        header=True,
        escape='"',
        emptyValue="",
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    ).csv(path)


def write_results(current: DataFrame, path: str, model: str) -> None:
    """A model's current results into `<path>/<model>`: seven columns."""
    rows = result_rows(current.where(F.col("model") == model))
    _write_csv(rows.select(*RESULT_COLUMNS), f"{path}/{model}")


def write_error_rows(current: DataFrame, path: str, model: str) -> None:
    """A model's rows without a prediction into `<path>/error_output_<model>`: five columns."""
    rows = error_rows(result_rows(current.where(F.col("model") == model)), "llm_prediction")
    _write_csv(rows.select(*ANNOTATION_COLUMNS), f"{path}/error_output_{model}")


def predictions_export(answered: DataFrame) -> DataFrame:
    """The nine exported columns of rows with `prediction`."""
    return answered.withColumn("correct", correct()).select(*PREDICTION_COLUMNS)


def write_predictions(answered: DataFrame, path: str, model: str, run_ts: str) -> str:
    """Predictions of one model into `<path>/<model>_<run_ts>/predictions`; returns the folder."""
    folder = f"{path}/{model}_{run_ts}"
    rows = predictions_export(answered.where(F.col("model") == model))
    _write_csv(
        rows.withColumn("correct", F.initcap(F.col("correct").cast("string"))),
        f"{folder}/predictions",
    )
    return folder


def metrics_record(row) -> dict:
    """A row of `rounded_metrics` as nested values."""
    return {
        **{name: row[name] for name in RATIOS},
        "confusion_matrix": {cell: row[cell.lower()] for cell in _CELLS},
        **{name: row[name] for name in _COUNTS},
    }


_CELLS = ("TP", "TN", "FP", "FN")
_COUNTS = ("total", "valid", "errors")
_RECORD = T.StructType(
    [
        *[T.StructField(name, T.DoubleType()) for name in RATIOS],
        T.StructField(
            "confusion_matrix", T.StructType([T.StructField(c, T.LongType()) for c in _CELLS])
        ),
        *[T.StructField(name, T.LongType()) for name in _COUNTS],
    ]
)


def _write_one(session, record: dict, schema: T.StructType, path: str) -> None:
    session.createDataFrame([record], schema).coalesce(1).write.mode("overwrite").json(path)


def write_metrics(metrics: DataFrame, path: str, model: str, run_ts: str) -> str:
    """One model's metrics as JSON into `<path>/<model>_<run_ts>/metrics`; returns the folder."""
    row = rounded_metrics(metrics.where(F.col("model") == model)).first()
    if row is None:
        raise ValueError(f"no results for model {model!r}")
    folder = f"{path}/{model}_{run_ts}"
    record = {"model": model, "timestamp": run_ts, **metrics_record(row)}
    names = [T.StructField(name, T.StringType()) for name in ("model", "timestamp")]
    schema = T.StructType([*names, *_RECORD.fields])
    _write_one(metrics.sparkSession, record, schema, f"{folder}/metrics")
    return folder


def write_comparison(metrics: DataFrame, path: str, models=MODELS) -> None:
    """One JSON object from model name to metrics into `<path>/comparison`, in the order given."""
    names = [name for name, _ in models]
    # at most one row per registered model
    found = {row["model"]: row for row in rounded_metrics(metrics.where(F.col("model").isin(names))).collect()}
    records = {name: metrics_record(found[name]) for name in names if name in found}
    schema = T.StructType([T.StructField(name, _RECORD) for name in records])
    _write_one(metrics.sparkSession, records, schema, f"{path}/comparison")
