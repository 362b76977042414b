import random
import re

import pytest
from pyspark.sql import functions as F

from criteria_engine.operators import keyed
from criteria_engine.operators.models import select_models
from criteria_engine.plans.resume import run_models
from criteria_engine.sources import segments
from criteria_engine.sources.attempts import append_attempts, next_run, read_attempts
from criteria_engine.storage import names
from helpers import TracingScorer, attempts_table, one_by_one, rows_table, trace

QWEN = select_models("qwen")


def current(spark, path):
    rows = keyed.current_results(read_attempts(spark, path)).select("model", "criteria_text", "run_no", "seq", "answered")
    return sorted(map(tuple, rows.collect()))


def history(seed, runs, keys=12):
    """Runs that ask what is open, some answers failing."""
    draw, done = random.Random(seed), set()
    for run in range(1, runs + 1):
        attempts = []
        for model in ("qwen", "gpt5"):
            for seq in range(keys):
                key = f"k{seq % (keys - 2)}"
                if (model, key) not in done and draw.random() < 0.7:
                    ok = draw.random() < 0.3
                    attempts.append((model, run, seq, key, ok))
                    if ok:
                        done.add((model, key))
        yield run, attempts


def files(folder):
    return [f for f in folder.rglob("*.parquet") if f.is_file()]


def test_merges_change_no_result_and_bound_the_files(spark, tmp_path):
    plain, merged = str(tmp_path / "plain"), str(tmp_path / "merged")
    most = 0
    for run, attempts in history(1, 14, keys=40):
        if not attempts:
            continue
        table = attempts_table(spark, attempts).coalesce(1)
        for path in (plain, merged):
            append_attempts(table, path)
        segments.compact(spark, merged, runs=3, bucket_rows=8)
        assert segments.last_run(spark, merged) == run
        most = max(most, len(names(spark, f"{merged}/runs")))
    assert current(spark, merged) == current(spark, plain)
    assert next_run(read_attempts(spark, merged)) == next_run(read_attempts(spark, plain))
    assert most <= 6 and len(names(spark, f"{merged}/manifests")) <= 2
    state = segments.manifest(spark, merged)
    assert len(state["segments"]) <= 3 and len(names(spark, f"{merged}/segments")) <= 6
    # a row per key of merged runs
    rows = read_attempts(spark, merged).where(F.col("run_no") <= state["merged"])
    assert rows.groupBy("model", "key_hash").count().where("count > 3").count() == 0


def test_a_merge_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    for _, attempts in history(2, 4):
        append_attempts(attempts_table(spark, attempts), path)
    before = current(spark, path)

    def broken(*_):
        raise OSError("driver lost")

    with monkeypatch.context() as patch:  # between the new segment and its manifest
        patch.setattr(segments, "write_record", broken)
        with pytest.raises(OSError):
            segments.compact(spark, path, runs=2)
    assert current(spark, path) == before and segments.manifest(spark, path)["version"] == 0
    with monkeypatch.context() as patch:  # between the manifest and the removal of what it replaces
        patch.setattr(segments, "_sweep", broken)
        with pytest.raises(OSError):
            segments.compact(spark, path, runs=2)
    assert current(spark, path) == before and segments.manifest(spark, path)["merged"] == 4
    assert not segments.compact(spark, path, runs=1)
    append_attempts(attempts_table(spark, [("qwen", 5, 99, "new", True)]), path)
    assert segments.compact(spark, path, runs=1)
    # leftovers of the broken merge are gone, and what both manifests name is there
    named = {s["name"] for s in segments.manifest(spark, path)["segments"]}
    assert named <= set(names(spark, f"{path}/segments")) and len(names(spark, f"{path}/segments")) <= 2
    assert len(current(spark, path)) == len(before) + 1


def test_a_reader_outlives_the_next_merge(spark, tmp_path):
    path = str(tmp_path / "log")
    append_attempts(attempts_table(spark, [("qwen", 1, 0, "a", False), ("qwen", 1, 1, "b", True)]), path)
    reader = read_attempts(spark, path)
    segments.compact(spark, path, runs=1)
    assert reader.count() == 2
    reader = read_attempts(spark, path)
    append_attempts(attempts_table(spark, [("qwen", 2, 0, "a", True)]), path)
    segments.compact(spark, path, runs=1)
    assert reader.count() == 2 and len(current(spark, path)) == 2


def buckets_read(frame):
    """Sizes of the bucket filters that reach the scans of segments."""
    for setting in ("spark.sql.debug.maxToStringFields", "spark.sql.maxMetadataStringLength"):
        frame.sparkSession.conf.set(setting, "100000")
    plan = frame._jdf.queryExecution().executedPlan().toString()
    found = re.findall(r"PartitionFilters: \[[^\]]*?bucket#\d+ (?:IN|INSET) \(?([\d, ]*)", plan)
    return [len(numbers.rstrip(", ").split(",")) for numbers in found]


def test_a_few_keys_read_a_few_buckets(spark, tmp_path):
    path, n = str(tmp_path / "log"), 3000
    append_attempts(attempts_table(spark, [("qwen", 1, i, f"k{i}", i % 2 == 0) for i in range(n)]), path)
    segments.compact(spark, path, runs=1, bucket_rows=8)
    assert segments.manifest(spark, path)["segments"][0]["bits"] == 9
    near = rows_table(spark, [f"k{i}" for i in range(0, 200, 2)])
    pruned = read_attempts(spark, path, near)
    wanted = near.select(segments.key_prefix(9)).distinct().count()
    assert wanted <= 100 and buckets_read(pruned) == [wanted]
    assert pruned.count() < n / 3
    whole = read_attempts(spark, path)
    for log in (pruned, whole):
        assert log.join(near.select("key_hash").distinct(), "key_hash", "left_semi").count() == 100
    assert not buckets_read(whole)


def test_runs_on_a_merged_log_match_the_sequential_loop(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(segments, "BUCKET_ROWS", 4)
    keys = [f"k{i % 25}" for i in range(60)]
    rows, log, calls = rows_table(spark, keys), str(tmp_path / "log"), tmp_path / "calls"
    calls.mkdir()
    table = {}

    def rule(seq, run):
        return (seq * 7 + run * 3) % 10 < 3

    for run in (1, 2, 3, 4):
        table, asked = one_by_one(keys, rule, table)
        number = run_models(rows, log, TracingScorer(calls, rule, run), QWEN, tasks=2, merge_runs=1)
        assert number == run or not asked
        assert [t[2] for t in trace(calls) if t[0] == run] == asked
        found = {(k, r, s, ok) for _, k, r, s, ok in current(spark, log)}
        assert found == {(k, *place) for k, place in table.items()}
    assert segments.manifest(spark, log)["merged"] >= 2


def test_a_run_that_is_started_again_takes_back_its_failures(spark, tmp_path):
    path = str(tmp_path / "log")
    append_attempts(attempts_table(spark, [("qwen", 1, 0, "a", False), ("qwen", 1, 1, "b", True)]), path)
    append_attempts(attempts_table(spark, [("qwen", 1, 0, "a", False)]), path, try_no=1)
    assert current(spark, path) == [("qwen", "a", 1, 0, False), ("qwen", "b", 1, 1, True)]
    with pytest.raises(ValueError, match="came after"):
        run_models(rows_table(spark, ["a"]), path, None, QWEN, run_no=0)
