"""Keyed results over the append-only attempts log.

A key's current result is its first valid attempt, or its last attempt if none is
valid. Everything here groups on (model, key_hash) with plain min/max of numbers,
which combines on the map side: however many rows share a key, each task passes on
one. Full rows are then picked by their unique attempt number.
"""

from pyspark.sql import DataFrame, functions as F

from criteria_engine.functions.responses import is_valid, prediction, reason
from criteria_engine.operators.models import fan_out
from criteria_engine.schemas import ANNOTATION_COLUMNS
from criteria_engine.storage import shared_folder, store

SLOT = ["model", "key_hash"]


def union_attempts(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.unionByName(new)


def with_answers(attempts: DataFrame) -> DataFrame:
    """Add `prediction` and `reason`, parsed on read."""
    return attempts.withColumns({"prediction": prediction(), "reason": reason()})


def answered_keys(attempts: DataFrame) -> DataFrame:
    """Distinct (model, key_hash) with a valid answer."""
    return attempts.where("answered").select(*SLOT).distinct()


def _plain(table: DataFrame, name: str) -> DataFrame:
    """Stored, for a join whose other side has hot keys.

    Adaptive execution splits a hot partition only if both sides are plain tables
    below their shuffles, so an aggregate is stored first; it has a row per key.
    """
    return store(table, f"{shared_folder(table.sparkSession)}/{name}")[0]


def cached_rows(rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """Rows (with `model` and `key_hash`) whose key has a valid answer."""
    return rows.join(_plain(answered_keys(attempts), "answered"), SLOT, "left_semi")


def pending_rows(rows: DataFrame, attempts: DataFrame) -> DataFrame:
    """Rows (with `model` and `key_hash`) whose key has no valid answer."""
    return rows.join(_plain(answered_keys(attempts), "answered"), SLOT, "left_anti")


def pending_heads(rows: DataFrame, attempts: DataFrame, models) -> DataFrame:
    """First row of every key with models still to answer: key_hash, seq, open_models.

    Rows and stored answers are reduced to one per key before they are joined, on the
    partitioning of that reduction, so a key with many rows costs one row per task.
    """
    names = [name for name, _ in models]
    heads = rows.groupBy("key_hash").agg(F.min("seq").alias("seq"))
    # the set holds model names, so it never outgrows the registry
    done = (
        attempts.where(F.col("answered") & F.col("model").isin(names))
        .groupBy("key_hash")
        .agg(F.collect_set("model").alias("done"))
    )
    wanted = F.array(*map(F.lit, names))
    left = F.array_except(wanted, F.coalesce("done", F.array().cast("array<string>")))
    return (
        heads.join(done, "key_hash", "left")
        .select("key_hash", "seq", left.alias("open_models"))
        .where(F.size("open_models") > 0)
    )


def current_results(attempts: DataFrame) -> DataFrame:
    """One attempt per (model, key): the first valid one, else the last."""
    chosen = attempts.groupBy(*SLOT).agg(
        F.coalesce(
            F.min(F.when(F.col("answered"), F.col("attempt_no"))), F.max("attempt_no")
        ).alias("attempt_no")
    )
    return attempts.join(chosen.select("model", "attempt_no"), ["model", "attempt_no"], "left_semi")


def calls_needed(attempts: DataFrame) -> DataFrame:
    """Attempts a run really asks for: those with no valid attempt earlier in their key."""
    first_valid = (
        attempts.where("answered")
        .groupBy(*SLOT)
        .agg(F.min("attempt_no").alias("_first_valid"))
    )
    return (
        attempts.join(_plain(first_valid, "first_valid"), SLOT, "left")
        .where(F.col("_first_valid").isNull() | (F.col("attempt_no") <= F.col("_first_valid")))
        .select(attempts.columns)
    )


def result_rows(attempts: DataFrame) -> DataFrame:
    """Stored form of results: annotation columns, `llm_prediction`, `llm_reason`."""
    return attempts.select(
        "model",
        *ANNOTATION_COLUMNS,
        prediction().alias("llm_prediction"),
        reason().alias("llm_reason"),
    )


def valid_predictions(rows: DataFrame, predicted: str = "prediction") -> DataFrame:
    return rows.where(is_valid(predicted))


def error_rows(rows: DataFrame, predicted: str = "prediction") -> DataFrame:
    """Rows without a 0/1 prediction; a missing one counts as an error."""
    return rows.where(~is_valid(predicted))


def dry_run_counts(rows: DataFrame, attempts: DataFrame, models) -> DataFrame:
    """Per model: rows already answered and rows to process; nothing is scored.

    Rows are counted per key first, so the join sees each key once.
    """
    counted = fan_out(rows.groupBy("key_hash").agg(F.count("*").alias("n")), models)
    done = answered_keys(attempts).withColumn("_done", F.lit(True))
    n = F.col("n")
    return (
        counted.join(done, SLOT, "left")
        .groupBy("ord", "model")
        .agg(
            F.coalesce(F.sum(F.when(F.col("_done"), n)), F.lit(0)).alias("cached"),
            F.coalesce(F.sum(F.when(F.col("_done").isNull(), n)), F.lit(0)).alias("to_process"),
        )
    )


def run_summary(rows: DataFrame, attempts: DataFrame, run_no: int, models) -> DataFrame:
    """Per model: rows asked and skipped in run `run_no`, and what is stored after it."""
    per_model = with_answers(current_results(attempts)).groupBy("model").agg(
        F.count("*").alias("stored"),
        F.count_if(is_valid("prediction")).alias("valid"),
        F.count_if(is_valid("prediction") & (F.col("label") == F.col("prediction"))).alias(
            "correct"
        ),
        F.count_if(~is_valid("prediction")).alias("failed"),
    )
    asked = attempts.where(F.col("run_no") == run_no).groupBy("model").agg(F.count("*").alias("new"))
    loaded = rows.agg(F.count("*").alias("loaded"))

    def number(name):
        return F.coalesce(F.col(name), F.lit(0))

    return (
        fan_out(loaded, models)
        .join(per_model, "model", "left")
        .join(asked, "model", "left")
        .select(
            "ord",
            "model",
            number("new").alias("new"),
            (F.col("loaded") - number("new")).alias("cached"),
            *[number(c).alias(c) for c in ("stored", "valid", "correct", "failed")],
        )
    )
