import random

import pytest

from criteria_engine.operators import keyed, metrics
from criteria_engine.operators.models import select_models
from criteria_engine.plans import grading
from criteria_engine.plans.grading import grade
from criteria_engine.plans.resume import run_models
from criteria_engine.sources import segments
from criteria_engine.sources.attempts import append_attempts, read_attempts
from criteria_engine.storage import names
from helpers import TracingScorer, attempts_table, rows_table

QWEN = select_models("qwen")


def rows(frame):
    return sorted(map(tuple, frame.select("model", *grading.NUMBERS, *metrics.RATIOS).collect()))


def whole(spark, path):
    return rows(metrics.classification_metrics(keyed.with_answers(keyed.current_results(read_attempts(spark, path)))))


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_the_whole_after_every_run(spark, tmp_path, monkeypatch, seed):
    draw, path, done = random.Random(seed), str(tmp_path / "log"), set()
    read = []
    monkeypatch.setattr(grading, "read_runs", lambda s, p, runs: read.extend(runs) or segments.read_runs(s, p, runs))
    for run in (1, 2, 3, 4):
        attempts = []
        for model in ("qwen", "gpt5"):
            for seq in range(10):
                key = f"k{seq % 7}"
                if (model, key) not in done and draw.random() < 0.6:
                    ok = draw.random() < 0.4
                    attempts.append((model, run, seq, key, ok))
                    done |= {(model, key)} if ok else set()
        append_attempts(attempts_table(spark, attempts), path)
        assert rows(grade(spark, path)) == whole(spark, path)
    # only the new run is read each time
    assert read == [2, 3, 4]
    assert rows(grade(spark, path)) == whole(spark, path) and read == [2, 3, 4]
    assert len(names(spark, f"{path}/grades")) == 4


def test_merged_runs_restarted_runs_and_no_runs(spark, tmp_path):
    path = str(tmp_path / "log")
    (tmp_path / "calls").mkdir()
    table = rows_table(spark, [f"k{i % 6}" for i in range(12)])

    def run(rule, **options):
        return run_models(table, path, TracingScorer(tmp_path / "calls", rule), QWEN, tasks=2, **options)

    assert run(lambda seq, _: seq == 0) == 1
    assert rows(grade(spark, path)) == whole(spark, path)
    assert run(lambda seq, _: seq < 2, run_no=1) == 1
    assert rows(grade(spark, path)) == whole(spark, path)
    assert run(lambda seq, _: seq < 3) == 2
    assert rows(grade(spark, path)) == whole(spark, path)
    segments.compact(spark, path, runs=1)
    assert rows(grade(spark, path)) == whole(spark, path)
    assert run(lambda seq, _: seq < 4, merge_runs=1) == 3
    segments.compact(spark, path, runs=1)  # merged before it was graded
    assert rows(grade(spark, path)) == whole(spark, path)


def test_a_broken_update_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "log")
    append_attempts(attempts_table(spark, [("qwen", 1, 0, "a", False)]), path)
    grade(spark, path)
    append_attempts(attempts_table(spark, [("qwen", 2, 0, "a", True)]), path)
    with monkeypatch.context() as patch:
        patch.setattr(grading, "write_record", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            grade(spark, path)
    assert rows(grade(spark, path)) == whole(spark, path)
    assert len(names(spark, f"{path}/grades")) == 4
