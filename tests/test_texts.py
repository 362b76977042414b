import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from criteria_engine.functions.text import key_hash, text_hash
from criteria_engine.operators import keyed
from criteria_engine.operators.models import select_models
from criteria_engine.plans import driver_tables, resume
from criteria_engine.plans.resume import run_models
from criteria_engine.schemas import ATTEMPTS, LOGGED
from criteria_engine.sources import segments, texts
from criteria_engine.sources.attempts import append_attempts, read_attempts
from criteria_engine.storage import names
from conftest import TESTDATA
from helpers import TracingScorer, attempts_table, rows_table

TWO = select_models("qwen,gpt5")


def stored(spark, path):
    found = texts.read_texts(spark, path)
    return sorted(r.criteria_text for r in found.collect()) if found is not None else []


def size(folder):
    return sum(f.stat().st_size for f in Path(folder).rglob("*.parquet") if f.is_file())


def test_a_text_is_stored_once_over_models_tries_and_runs(spark, tmp_path):
    """Bytes of a log with long sentences grow with the attempts' narrow rows only."""
    draw = random.Random(5)
    keys = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=20_000)) for _ in range(10)]
    rows, path = rows_table(spark, keys), str(tmp_path / "log")
    sizes = []
    for run in range(1, 5):
        run_models(rows, path, TracingScorer(tmp_path, lambda seq, run: False), TWO, tasks=2, merge_runs=3)
        assert stored(spark, path) == sorted(keys)
        sizes.append(size(path))
    whole = sum(map(len, keys))
    # letters take 0.6 bytes each at least; a second copy would be seen, a merge keeps the one before
    assert 0.55 * whole < sizes[0] < 1.3 * whole and sizes[2] - sizes[0] < 0.3 * whole
    assert sizes[3] < 2.6 * whole
    log = read_attempts(spark, path)
    assert {(r.model, r.criteria_text) for r in log.collect()} == {(m, k) for m in ("qwen", "gpt5") for k in keys}


def test_random_histories_keep_every_text(spark, tmp_path):
    path, draw, want = str(tmp_path / "log"), random.Random(3), {}
    for run in range(1, 7):
        attempts = [("qwen", run, seq, f"k{draw.randrange(30)}", draw.random() < 0.5) for seq in range(12)]
        append_attempts(attempts_table(spark, attempts), path)
        want.update({(run, seq): key for _, _, seq, key, _ in attempts})
        segments.compact(spark, path, runs=2, bucket_rows=4)
        log = read_attempts(spark, path)
        assert log.columns == ATTEMPTS.names
        assert all(want[r.run_no, r.seq] == r.criteria_text for r in log.select("run_no", "seq", "criteria_text").collect())
        assert stored(spark, path) == sorted(set(want.values()))
    state = segments.manifest(spark, path)
    assert len(state["texts"]) <= 3 and state["texts"][0]["bits"] > 0
    # what the last two manifests do not name is gone
    assert len(names(spark, f"{path}/texts")) <= 5 and len(names(spark, f"{path}/fresh")) <= 8


def test_an_addition_that_breaks_off_counts_for_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")

    def broken(*_):
        raise OSError("driver lost")

    rows = rows_table(spark, ["a", "b", "a"])
    with monkeypatch.context() as patch:  # between the texts and their record
        patch.setattr(texts, "write_record", broken)
        with pytest.raises(OSError):
            texts.add_texts(rows, path)
    assert stored(spark, path) == []
    assert texts.add_texts(rows, path) == 2 and texts.add_texts(rows, path) == 0
    assert stored(spark, path) == ["a", "b"]


@pytest.mark.parametrize("step", ["write_record", "_sweep"])
def test_a_merge_that_breaks_off_keeps_each_text_once(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "log")
    for run in (1, 2):
        append_attempts(attempts_table(spark, [("qwen", run, i, f"k{i + run}", False) for i in range(4)]), path)
    want = [f"k{i}" for i in range(1, 6)]

    def broken(*_):
        raise OSError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(segments, step, broken)
        with pytest.raises(OSError):
            segments.compact(spark, path, runs=1)
    assert stored(spark, path) == want
    append_attempts(attempts_table(spark, [("qwen", 3, 9, "k1", True), ("qwen", 3, 10, "new", True)]), path)
    reader = read_attempts(spark, path)
    assert stored(spark, path) == [*want, "new"]
    segments.compact(spark, path, runs=1)
    assert stored(spark, path) == [*want, "new"]
    assert None not in {r.criteria_text for r in reader.collect()}


def test_rows_of_a_key_with_several_texts(spark, tmp_path):
    """With a key of other columns every asked row keeps its own sentence."""
    keys = [f"k{i}" for i in range(40)]
    rows = rows_table(spark, keys).withColumn("key_hash", key_hash(("trial_id",)))
    path = str(tmp_path / "log")
    run_models(rows, path, TracingScorer(tmp_path, lambda seq, run: seq == 30), TWO, tasks=2, chunk_rows=4)
    log = read_attempts(spark, path)
    assert sorted((r.model, r.seq, r.criteria_text) for r in log.collect()) == sorted(
        (m, i, keys[i]) for m in ("qwen", "gpt5") for i in range(31)
    )
    assert set(keys[:31]) <= set(stored(spark, path))


def test_nulls_and_empty_texts(spark, tmp_path):
    path = str(tmp_path / "log")
    base = attempts_table(spark, [("qwen", 1, i, "" if i else "x", True) for i in range(3)])
    odd = base.withColumn("criteria_text", F.when(F.col("seq") < 2, F.col("criteria_text")))
    append_attempts(odd, path)
    assert sorted((r.seq, r.criteria_text) for r in read_attempts(spark, path).collect()) == [(0, "x"), (1, ""), (2, None)]
    assert stored(spark, path) == ["", "x"]
    append_attempts(odd.limit(0), str(tmp_path / "none"))
    assert read_attempts(spark, str(tmp_path / "none")).count() == 0


def test_key_operators_read_no_texts_and_known_ones_are_looked_up_in_few_buckets(spark, tmp_path):
    path, n = str(tmp_path / "log"), 2000
    append_attempts(attempts_table(spark, [("qwen", 1, i, f"k{i}", True) for i in range(n)]), path)
    segments.compact(spark, path, runs=1, bucket_rows=32)
    logged = read_attempts(spark, path, texts=False)
    assert logged.columns == LOGGED.names and "criteria_text" not in plan(keyed.current_results(logged))
    near = rows_table(spark, [f"k{i}" for i in range(5)])
    known = texts.read_texts(spark, path, near)
    assert known.join(near, "text_hash", "left_semi").count() == 5
    assert known.count() < n / 5
    assert texts.add_texts(rows_table(spark, ["k1", "other", "k2", "other"]), path) == 1
    assert len(stored(spark, path)) == n + 1


def test_a_text_that_most_attempts_share_is_split(spark, tmp_path):
    """The join with the texts splits its hot partition."""
    path, n = str(tmp_path / "log"), 120_000
    wide = F.concat(F.col("id").cast("string"), F.lit("x" * 60))
    key = F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 3000))
    base = attempts_table(spark, [("qwen", 1, 0, "a", False)]).limit(1).drop("seq", "attempt_no", "criteria_text", "raw_response", "key_hash")
    many = base.crossJoin(spark.range(n)).select(
        "*", F.col("id").alias("seq"), F.col("id").alias("attempt_no"), key.alias("criteria_text"), wide.alias("raw_response")
    )
    append_attempts(many.withColumn("key_hash", key_hash()).select(*ATTEMPTS.names), path)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        found = read_attempts(spark, path).select("criteria_text", "raw_response", "seq")
        rows = found.collect()
        shown = plan(found)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(rows) == n and sum(r.criteria_text == "hot" for r in rows) == n * 2 // 3
    assert "skewed" in shown


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def test_log_of_the_queries_is_joined_without_sentences(spark):
    path = str(TESTDATA / "sf0.001")
    whole = driver_tables.staged(spark, path)
    first = driver_tables.prior(spark, path)
    assert first.columns == LOGGED.names
    logged = driver_tables.log(spark, path)
    hashes = {bytes(r[0]) for r in logged.select("text_hash").distinct().collect()}
    stored = texts.read_texts(spark, driver_tables.log_folder(spark, path)).collect()
    wanted = {bytes(r.text_hash): r.criteria_text for r in whole.collect()}
    assert sorted(bytes(r.text_hash) for r in stored) == sorted(hashes)
    assert all(wanted[bytes(r.text_hash)] == r.criteria_text for r in stored)


def test_sentences_of_asked_rows_only(spark, tmp_path):
    rows, path = rows_table(spark, ["a", "b", "a", "c", None]), str(tmp_path / "log")
    asked = rows.select("seq", "text_hash").where("seq in (1, 2, 4)")
    assert texts.add_texts(rows, path, asked=asked) == 2 and texts.add_texts(rows, path, asked=asked) == 0
    assert sorted(r.criteria_text for r in texts.read_texts(spark, path).collect()) == ["a", "b"]


def test_a_run_takes_sentences_from_its_rows_by_digest(spark, tmp_path, monkeypatch):
    plain = []

    def add(rows, path, number="seq", asked=None):
        plain.append("Join" in rows._jdf.queryExecution().optimizedPlan().toString())
        return texts.add_texts(rows, path, number, asked)

    monkeypatch.setattr(resume, "add_texts", add)
    rows = rows_table(spark, ["a", "b", "a"])
    resume.run_models(rows, str(tmp_path / "log"), driver_tables.rule_scorer(), max_tries=1)
    assert plain and not plain[0]
