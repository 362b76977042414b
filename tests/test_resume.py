import random
import time

import pytest
from pyspark.sql import functions as F

from criteria_engine.operators import keyed
from criteria_engine.operators.models import select_models
from criteria_engine.plans import resume
from criteria_engine.plans.resume import run_models
from criteria_engine.sources.attempts import read_attempts
from helpers import TracingScorer, one_by_one, rows_table, trace

QWEN = select_models("qwen")


def stored(spark, path):
    """Current results as key -> (run, seq, valid)."""
    current = keyed.with_answers(keyed.current_results(read_attempts(spark, path)))
    rows = current.select("model", "criteria_text", "run_no", "seq", "prediction").collect()
    found = {(r.model, r.criteria_text): (r.run_no, r.seq, r.prediction is not None) for r in rows}
    assert len(found) == len(rows)
    return found


def rule(seq, run):
    return (seq * 7 + run * 3) % 10 < 4


@pytest.fixture(params=["-1", "10MB"])
def broadcasts(spark, request):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, request.param)
    yield
    spark.conf.set(name, before)


def test_runs_match_the_sequential_loop(spark, tmp_path, broadcasts):
    """Three runs over the same rows, with and without broadcasts."""
    rng = random.Random(2)
    keys = [f"k{rng.randrange(25)}" for _ in range(150)]
    rows = rows_table(spark, keys)
    log, calls = str(tmp_path / "log"), tmp_path / "calls"
    calls.mkdir()
    table = {}
    for run in (1, 2, 3):
        table, asked = one_by_one(keys, rule, table)
        number = run_models(rows, log, TracingScorer(calls, rule, run), QWEN, tasks=4)
        assert number == run
        assert stored(spark, log) == {("qwen", k): v for k, v in table.items()}
        assert [t[2] for t in trace(calls) if t[0] == run] == asked


def test_models_do_not_share_answers(spark, tmp_path):
    rows, log = rows_table(spark, ["a", "b"]), str(tmp_path / "log")
    calls = tmp_path / "calls"
    calls.mkdir()
    scorer = TracingScorer(calls, lambda seq, run: True)
    run_models(rows, log, scorer, QWEN)
    run_models(rows, log, scorer, select_models("gpt5,qwen"))
    assert [t[1:3] for t in trace(calls)] == [("gpt5", 0), ("gpt5", 1), ("qwen", 0), ("qwen", 1)]


@pytest.mark.parametrize("first_valid, chunk_rows", [(300, 8), (25, 8), (599, 1), (300, 256)])
def test_a_large_key_that_keeps_failing(spark, tmp_path, monkeypatch, first_valid, chunk_rows):
    """One key holds a third of the rows and gets its first valid answer late; the calls are the loop's."""
    monkeypatch.setattr(resume, "DOUBLINGS", 3)
    n = 600
    keys = ["hot" if i % 3 == 0 else f"k{i}" for i in range(n)]

    def late(seq, run):
        return seq % 3 > 0 or seq >= first_valid

    calls = tmp_path / "calls"
    calls.mkdir()
    log = str(tmp_path / "log")
    rows = rows_table(spark, keys)
    run_no = run_models(
        rows, log, TracingScorer(calls, late), QWEN, tasks=4, chunk_rows=chunk_rows
    )
    table, asked = one_by_one(keys, late)
    assert stored(spark, log) == {("qwen", k): v for k, v in table.items()}
    made = [t[2] for t in trace(calls)]
    assert sorted(made) == sorted(asked)
    summary = keyed.run_summary(rows, read_attempts(spark, log), run_no, QWEN).first()
    assert (summary.new, summary.cached) == (len(asked), n - len(asked))


def test_models_of_one_row_end_at_different_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(resume, "DOUBLINGS", 1)
    keys, calls = ["hot"] * 40, tmp_path / "calls"
    calls.mkdir()
    both = select_models("gpt5,qwen")

    class Differs(TracingScorer):
        def __call__(self, requests):
            self.rule = lambda seq, run: False
            out = super().__call__(requests)
            ok = requests["seq"] >= requests["model"].map({"gpt5": 9, "qwen": 33})
            out.loc[ok.to_numpy(), "raw_response"] = "PREDICTION: 1"
            return out

    run_models(rows_table(spark, keys), str(tmp_path / "log"), Differs(calls, None), both, tasks=3, chunk_rows=2)
    asked = sorted(t[1:3] for t in trace(calls))
    assert asked == [("gpt5", s) for s in range(10)] + [("qwen", s) for s in range(34)]


def test_a_crash_in_the_first_wave_keeps_finished_tasks(spark, tmp_path):
    keys = [f"k{i}" for i in range(40)]
    rows, log = rows_table(spark, keys), str(tmp_path / "log")
    calls = tmp_path / "calls"
    calls.mkdir()

    class Breaks(TracingScorer):
        def __call__(self, requests):
            if (requests["seq"] == 39).any():
                time.sleep(8)  # the other tasks end meanwhile
                raise SystemError("worker lost")
            return super().__call__(requests)

    def always(seq, run):
        return True

    with pytest.raises(Exception, match="worker lost"):
        run_models(rows, log, Breaks(calls, always), QWEN, tasks=8)
    kept = read_attempts(spark, log).count()
    assert kept == len(trace(calls)) >= 20
    run_models(rows, log, TracingScorer(calls, always, run=2), QWEN, tasks=8)
    assert len([t for t in trace(calls) if t[0] == 2]) == 40 - kept
    assert len(stored(spark, log)) == 40


def test_a_key_whose_rows_all_fail(spark, tmp_path):
    keys, log = ["hot"] * 50 + ["other"], str(tmp_path / "log")
    calls = tmp_path / "calls"
    calls.mkdir()
    run_models(
        rows_table(spark, keys),
        log,
        TracingScorer(calls, lambda seq, run: False),
        QWEN,
        tasks=3,
        chunk_rows=4,
    )
    assert [t[2] for t in trace(calls)] == list(range(51))
    assert stored(spark, log) == {("qwen", "hot"): (1, 49, False), ("qwen", "other"): (1, 50, False)}


def test_ranks_do_not_depend_on_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(resume, "DOUBLINGS", 4)
    keys = ["hot" if i % 3 else f"k{i % 5}" for i in range(400)]
    rows = rows_table(spark, keys).select(F.lit("m").alias("model"), "key_hash", "seq")
    ranked, found = resume._ranked(rows, str(tmp_path / "ranks"), 2)
    want, seen = {}, {}
    for seq, key in enumerate(keys):
        place = seen.get(key, 0)
        size, chunk, start = 2, 0, 0
        while place >= start + size:
            start, chunk = start + size, chunk + 1
            size = 2 * 2 ** min(chunk, resume.DOUBLINGS)
        want[seq] = chunk
        seen[key] = place + 1
    assert {r.seq: r.chunk for r in ranked.collect()} == want
    assert found == {"n": 400, "last": max(want.values())}


def test_a_crash_keeps_the_answers_before_it(spark, tmp_path):
    """A run that breaks in its second wave resumes behind the stored first wave."""
    keys = [f"k{i % 10}" for i in range(30)]
    rows, log = rows_table(spark, keys), str(tmp_path / "log")
    calls = tmp_path / "calls"
    calls.mkdir()

    class Breaks(TracingScorer):
        def __call__(self, requests):
            if (requests["seq"] >= 10).any():
                raise SystemError("worker lost")
            return super().__call__(requests)

    def half(seq, run):
        return seq % 2 == 0

    with pytest.raises(Exception, match="worker lost"):
        run_models(rows, log, Breaks(calls, half), QWEN, tasks=2)
    assert sum(valid for _, _, valid in stored(spark, log).values()) == 5

    assert run_models(rows, log, TracingScorer(calls, half, run=2), QWEN, tasks=2) == 2
    # only keys without a valid answer are asked again, from their first row on
    assert {t[2] % 10 for t in trace(calls) if t[0] == 2} == {1, 3, 5, 7, 9}
    assert [t[2] for t in trace(calls) if t[0] == 1] == list(range(10))


def test_nothing_to_do(spark, tmp_path):
    log = str(tmp_path / "log")
    calls = tmp_path / "calls"
    calls.mkdir()
    scorer = TracingScorer(calls, lambda seq, run: True)
    rows = rows_table(spark, ["a"])
    assert run_models(rows, log, scorer, QWEN) == 1
    assert run_models(rows, log, scorer, QWEN) == 2
    assert len(trace(calls)) == 1
    assert run_models(rows.limit(0), str(tmp_path / "other"), scorer, QWEN) == 1
