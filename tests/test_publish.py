import pytest

from criteria_engine.operators.models import select_models
from criteria_engine.plans import publish as plans
from criteria_engine.sinks import exports
from criteria_engine.sources.attempts import append_attempts
from criteria_engine.storage import names
from helpers import attempts_table


def rows(spark, folder, model):
    return spark.read.option("header", True).csv(f"{folder}/{model}").count()


@pytest.fixture()
def place(spark, tmp_path):
    log, base = str(tmp_path / "log"), str(tmp_path / "exports")
    append_attempts(attempts_table(spark, [("qwen", 1, 0, "a", True), ("gpt5", 1, 0, "a", False), ("gpt5", 1, 1, "b", True)]), log)
    return log, base


def test_an_export_appears_as_a_whole(spark, place):
    log, base = place
    assert plans.published(spark, base) is None
    folder = plans.publish(spark, log, base, run_ts="t1")
    assert plans.published(spark, base) == folder
    assert names(spark, folder) == sorted(
        ["qwen", "gpt5", "error_output_qwen", "error_output_gpt5", "qwen_t1", "gpt5_t1", "comparison"]
    )
    assert (rows(spark, folder, "gpt5"), rows(spark, folder, "error_output_gpt5"), rows(spark, folder, "qwen")) == (2, 1, 1)
    assert names(spark, f"{folder}/gpt5_t1") == ["metrics", "predictions"]
    graded = spark.read.json(f"{folder}/comparison").first()
    assert (graded.gpt5.total, graded.gpt5.errors, graded.qwen.valid) == (2, 1, 1)
    # a model without results: no rows and no metrics
    other = plans.publish(spark, log, base, [name for name, _ in select_models("gpt4o,qwen")], run_ts="t2")
    assert rows(spark, other, "gpt4o") == 0 and names(spark, f"{other}/gpt4o_t2") == ["predictions"]


@pytest.mark.parametrize("step", ["write_results", "write_error_rows", "write_comparison"])
def test_an_export_that_breaks_off_is_never_seen(spark, place, monkeypatch, step):
    log, base = place
    first = plans.publish(spark, log, base)
    append_attempts(attempts_table(spark, [("qwen", 2, 1, "new", True)]), log)

    def broken(*_):
        raise OSError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(exports, step, broken)
        with pytest.raises(OSError):
            plans.publish(spark, log, base, run_ts="t")
    assert plans.published(spark, base) == first and rows(spark, first, "qwen") == 1
    second = plans.publish(spark, log, base)
    assert plans.published(spark, base) == second and rows(spark, second, "qwen") == 2
    # the broken one is gone, a reader of the one before can end
    assert len(names(spark, base)) == 4 and rows(spark, first, "qwen") == 1
    third = plans.publish(spark, log, base)
    assert {n for n in names(spark, base) if not n.endswith(".json")} == {f.rsplit("/", 1)[1] for f in (second, third)}


def test_nothing_to_publish(spark, tmp_path):
    folder = plans.publish(spark, str(tmp_path / "none"), str(tmp_path / "out"))
    assert plans.published(spark, str(tmp_path / "out")) == folder and names(spark, folder) == []
