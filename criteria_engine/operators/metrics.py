"""Grading: confusion counts, ratios and comparisons per model.

All of it is one grouped aggregate over (model, label, prediction): tasks combine
their rows to one per model before the shuffle. Ratios stay unrounded doubles.
"""

from pyspark.sql import DataFrame, functions as F

from criteria_engine.fixed_values import MODELS
from criteria_engine.functions.responses import is_valid
from criteria_engine.functions.rounding import round_exact
from criteria_engine.operators.models import registry_table

CELLS = ("tp", "tn", "fp", "fn")
COUNTS = ("total", "valid", "errors")
RATIOS = ("accuracy", "precision", "recall", "f1")
# Decimal places of the ratios in output.
PLACES = 4


def _ratio(part, whole):
    """0 for an empty denominator."""
    return F.coalesce(F.try_divide(part, whole), F.lit(0.0))


def _cells(label: str, predicted: str) -> list:
    gold, guess = F.col(label), F.col(predicted)
    return [
        F.count_if((gold == 1) & (guess == 1)).alias("tp"),
        F.count_if((gold == 0) & (guess == 0)).alias("tn"),
        F.count_if((gold == 0) & (guess == 1)).alias("fp"),
        F.count_if((gold == 1) & (guess == 0)).alias("fn"),
    ]


def _counts(predicted: str) -> list:
    errors = F.count_if(F.col(predicted).isNull())
    return [
        F.count("*").alias("total"),
        (F.count("*") - errors).alias("valid"),
        errors.alias("errors"),
    ]


def confusion_matrix(rows, by=("model",), label="label", predicted="prediction") -> DataFrame:
    """Counts with 1 as the positive class; other value pairs fall in no cell."""
    return rows.groupBy(*by).agg(*_cells(label, predicted))


def response_counts(rows, by=("model",), predicted="prediction") -> DataFrame:
    """total, valid (has a prediction) and errors (has none)."""
    return rows.groupBy(*by).agg(*_counts(predicted))


def classification_metrics(
    rows, by=("model",), label="label", predicted="prediction"
) -> DataFrame:
    """Confusion counts, response counts, accuracy, precision, recall and F1.

    With `by=()` there is exactly one row, also for empty input.
    """
    return with_ratios(classification_counts(rows, by, label, predicted))


def classification_counts(rows, by=("model",), label="label", predicted="prediction") -> DataFrame:
    """CELLS and COUNTS."""
    return rows.groupBy(*by).agg(*_cells(label, predicted), *_counts(predicted))


def with_ratios(counts: DataFrame) -> DataFrame:
    """Counts with accuracy, precision, recall and F1."""
    tp = F.col("tp")
    ratios = counts.withColumns(
        {
            "accuracy": _ratio(tp + F.col("tn"), F.col("valid")),
            "precision": _ratio(tp, tp + F.col("fp")),
            "recall": _ratio(tp, tp + F.col("fn")),
        }
    )
    precision, recall = F.col("precision"), F.col("recall")
    # from the unrounded ratios, in this order: the shorter form differs in the last bit
    return ratios.withColumn("f1", _ratio(2 * precision * recall, precision + recall))


def rounded_metrics(metrics: DataFrame) -> DataFrame:
    """The same rows with their ratios rounded to PLACES, for output."""
    return metrics.withColumns({name: round_exact(F.col(name), PLACES) for name in RATIOS})


def compare_models(results: DataFrame, registry=MODELS, predicted="prediction") -> DataFrame:
    """total, valid (prediction is 0 or 1), correct and accuracy for every registered model.

    Null numbers stand for a model without results. Ordered as registered.
    """
    per_model = results.groupBy("model").agg(
        F.count("*").alias("total"),
        F.count_if(is_valid(predicted)).alias("valid"),
        F.count_if(is_valid(predicted) & (F.col("label") == F.col(predicted))).alias("correct"),
    )
    return (
        registry_table(results.sparkSession, registry)
        .join(per_model, "model", "left")
        .select(
            "ord",
            "model",
            "total",
            "valid",
            "correct",
            F.when(
                F.col("total").isNotNull(), _ratio(F.col("correct"), F.col("valid"))
            ).alias("accuracy"),
        )
        .orderBy("ord")
    )


def compare_metrics(results: DataFrame, registry=MODELS) -> DataFrame:
    """accuracy, precision, recall and F1 of the models with results, ordered as registered."""
    return (
        registry_table(results.sparkSession, registry)
        .join(classification_metrics(results), "model")
        .select("ord", "model", *RATIOS)
        .orderBy("ord")
    )
