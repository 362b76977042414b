import random

import pytest
from pyspark.sql import functions as F

from criteria_engine.functions.text import key_hash
from criteria_engine.operators import keyed
from criteria_engine.operators.models import fan_out, select_models
from criteria_engine.sources.attempts import append_attempts, read_attempts
from helpers import attempts_table, one_by_one, rows_table

QWEN = select_models("qwen")


@pytest.fixture(scope="module")
def cases():
    rng = random.Random(11)
    found = []
    for i in range(300):
        keys = [f"{i}-{rng.randrange(4)}" for _ in range(rng.randrange(1, 10))]
        found.append((keys, [rng.random() < 0.4 for _ in keys]))
    return found


def test_current_row_and_calls_match_the_sequential_loop(spark, cases):
    attempts, current, asked = [], set(), set()
    for i, (keys, valid) in enumerate(cases):
        table, calls = one_by_one(keys, lambda seq, run: valid[seq])
        attempts += [(f"m{i}", 1, s, k, ok) for s, (k, ok) in enumerate(zip(keys, valid))]
        current |= {(f"m{i}", key, seq) for key, (_, seq, _) in table.items()}
        asked |= {(f"m{i}", seq) for seq in calls}
    df = attempts_table(spark, attempts)
    got = keyed.current_results(df).select("model", "criteria_text", "seq").collect()
    assert len(got) == len(current) and {tuple(r) for r in got} == current
    got = keyed.calls_needed(df).select("model", "seq").collect()
    assert len(got) == len(asked) and {tuple(r) for r in got} == asked


def test_later_runs_replace_failed_results_only(spark):
    df = attempts_table(
        spark,
        [
            ("m", 1, 5, "a", True),
            ("m", 1, 6, "b", False),
            ("m", 2, 1, "b", False),
            ("m", 2, 2, "c", False),
            ("m", 3, 0, "c", True),
            ("m", 3, 9, "a", False),
            ("n", 1, 5, "a", False),
        ],
    )
    got = keyed.current_results(df).select("model", "criteria_text", "run_no", "seq").collect()
    assert {tuple(r) for r in got} == {
        ("m", "a", 1, 5),
        ("m", "b", 2, 1),
        ("m", "c", 3, 0),
        ("n", "a", 1, 5),
    }


def test_cached_and_pending(spark):
    rows = rows_table(spark, ["a", "a", "b", "c"])
    log = attempts_table(
        spark, [("qwen", 1, 0, "a", True), ("qwen", 1, 2, "b", False), ("gpt5", 1, 3, "c", True)]
    )
    wanted = fan_out(rows, QWEN)
    assert {r.seq for r in keyed.cached_rows(wanted, log).collect()} == {0, 1}
    assert {r.seq for r in keyed.pending_rows(wanted, log).collect()} == {2, 3}
    heads = keyed.pending_heads(rows, log, select_models("qwen,gpt5")).collect()
    assert {r.seq: r.open_models for r in heads} == {
        0: ["gpt5"],
        2: ["qwen", "gpt5"],
        3: ["qwen"],
    }
    counts = keyed.dry_run_counts(rows, log, select_models("qwen,gpt4o")).collect()
    assert {r.model: (r.cached, r.to_process) for r in counts} == {"qwen": (2, 2), "gpt4o": (0, 4)}


def test_drug_can_join_the_key(spark):
    """Two drugs share a sentence's answer by default, and do not with a wider key."""
    rows = rows_table(spark, ["a", "a"])
    wide = rows.withColumn("key_hash", key_hash(("trial_id", "criteria_text", "drug_name")))
    none = read_attempts(spark, "/nonexistent/log")
    assert keyed.pending_heads(rows, none, QWEN).count() == 1
    assert keyed.pending_heads(wide, none, QWEN).count() == 2


def test_missing_log_is_empty(spark, tmp_path):
    assert read_attempts(spark, str(tmp_path / "none")).count() == 0


def test_run_summary(spark):
    rows = rows_table(spark, ["a", "a", "b", "c"])
    log = attempts_table(
        spark,
        [
            ("qwen", 1, 1, "a", True),  # label 1, predicted 1
            ("qwen", 1, 2, "b", False),
            ("qwen", 2, 2, "b", True),  # label 0, predicted 1
            ("qwen", 2, 3, "c", False),
        ],
    )
    got = keyed.run_summary(rows, log, 2, select_models("qwen,gpt5")).orderBy("ord").collect()
    assert [tuple(r)[1:] for r in got] == [
        ("qwen", 2, 2, 3, 2, 1, 1),
        ("gpt5", 0, 4, 0, 0, 0, 0),
    ]


def test_error_rows_and_results(spark):
    log = attempts_table(spark, [("m", 1, 0, "a", True), ("m", 1, 1, "b", False)])
    stored = keyed.result_rows(log)
    assert [r.criteria_text for r in keyed.error_rows(stored, "llm_prediction").collect()] == ["b"]
    valid = keyed.valid_predictions(keyed.with_answers(log)).collect()
    assert [(r.criteria_text, r.prediction, r.reason) for r in valid] == [("a", 1, "r")]


def test_a_hot_key_is_combined_before_the_shuffle(spark):
    """The aggregates on keys are partial hash aggregates on numbers."""
    log = attempts_table(spark, [("m", 1, 0, "a", True)])
    plan = keyed.current_results(log)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("HashAggregate") == 2
    assert "SortAggregate" not in plan and "Window" not in plan


def test_a_third_of_all_rows_in_one_key(spark):
    n = 60_000
    attempts = spark.range(n).select(
        F.lit("m").alias("model"),
        F.lit(1).alias("run_no"),
        F.col("id").alias("attempt_no"),
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, "hot")
        .otherwise(F.col("id").cast("string"))
        .cast("binary")
        .alias("key_hash"),
        (F.col("id") >= n // 2).alias("answered"),
    )
    hot = keyed.current_results(attempts).where(F.col("key_hash") == F.lit(b"hot"))
    assert [r.seq for r in hot.collect()] == [n // 2]
    asked = keyed.calls_needed(attempts)
    assert asked.where(F.col("key_hash") == F.lit(b"hot")).count() == n // 6 + 1
    assert asked.count() == n // 6 + 1 + n - n // 3


def test_joins_split_a_hot_key(spark, tmp_path):
    """Where every row of a key has to be kept, adaptive execution splits the hot partition.

    The models are a stored column of two values, as in a log.
    """
    n = 200_000
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).cast("string").cast("binary")
    model = F.when(F.col("id") % 6 < 5, "m").otherwise("o").alias("model")
    wide = F.concat(F.lit("text "), F.sha2(F.col("id").cast("string"), 512))
    spark.range(n).select(model, "id", key.alias("key_hash"), wide.alias("text")).write.parquet(
        str(tmp_path / "rows")
    )
    answered = (F.col("id") > 30_000).alias("answered")
    spark.range(n).select(
        model, key.alias("key_hash"), answered, F.col("id").alias("attempt_no"), wide.alias("text")
    ).write.parquet(str(tmp_path / "log"))
    rows, log = spark.read.parquet(str(tmp_path / "rows")), spark.read.parquet(str(tmp_path / "log"))
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1MB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "512KB",
    }
    before = {name: spark.conf.get(name) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    known = {i for i in range(n) if i > 30_000}
    hot = next(i for i in range(30_001, n) if i % 3 == 0)
    first = {i: hot if i % 3 == 0 else i if i in known else None for i in range(n)}
    try:
        for joined, want in (
            (keyed.cached_rows(rows, log), sum(first[i] is not None for i in range(n))),
            (keyed.pending_rows(rows, log), sum(first[i] is None for i in range(n))),
            (keyed.calls_needed(log), sum(first[i] is None or i <= first[i] for i in range(n))),
        ):
            assert len(joined.collect()) == want
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin(skew=true)" in plan
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_key_operators_read_no_texts(spark, tmp_path):
    append_attempts(attempts_table(spark, [("qwen", 1, 0, "a", True)]), str(tmp_path / "log"))
    rows_table(spark, ["a", "b"]).write.parquet(str(tmp_path / "rows"))
    log, rows = read_attempts(spark, str(tmp_path / "log")), spark.read.parquet(str(tmp_path / "rows"))
    heads = keyed.pending_heads(rows, log, QWEN)
    plan = heads._jdf.queryExecution().executedPlan().toString()
    assert "raw_response" not in plan and "criteria_text" not in plan
    assert "EqualTo(answered,true)" in plan
    assert "PartitionFilters: [isnotnull(model" in plan or "PartitionFilters: [(model" in plan
    assert plan.count("Exchange hashpartitioning") <= 2
    counts = keyed.dry_run_counts(rows, log, QWEN)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert "raw_response" not in plan and "criteria_text" not in plan
