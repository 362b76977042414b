import re
import threading
import time

import pandas as pd
import pytest
from pyspark.sql import functions as F

from criteria_engine.fixed_values import RATE_LIMIT_ERROR
from criteria_engine.functions import responses
from criteria_engine.operators.models import fan_out, select_models
from criteria_engine.operators.scoring import RateLimited, row_scorer, score, score_in_order
from helpers import TracingScorer, one_by_one, rows_table, trace

QWEN = select_models("qwen")


def wanted(spark, keys):
    return fan_out(rows_table(spark, keys), QWEN)


def answers(df):
    return {r.seq: (r.raw_response, r.error) for r in df.collect()}


def test_failures_become_data(spark):
    def call(model_id, system, user):
        if '"limit"' in user:
            raise RateLimited
        if '"down"' in user:
            raise ConnectionError("reset")
        if '"odd"' in user:
            raise KeyError
        return f" {model_id} "

    got = answers(score(wanted(spark, ["limit", "down", "odd", "fine"]), row_scorer(call)))
    assert got == {
        0: ("", RATE_LIMIT_ERROR),
        1: ("", "reset"),
        2: ("", "KeyError"),
        3: ("qwen/qwen3-32b", None),
    }


@pytest.mark.parametrize("max_tries", [1, 2, 3])
def test_only_retryable_rows_are_tried_again(spark, tmp_path, max_tries):
    folder = str(tmp_path)

    class Flaky(TracingScorer):
        def __call__(self, requests):
            super().__call__(requests)
            # row 0 never works, row 1 on its second try, row 2 fails for good
            seq, try_no = requests["seq"], requests["try_no"]
            again = (seq == 0) | (seq == 1) & (try_no < 2)
            error = pd.Series(None, index=seq.index, dtype=object)
            error[again], error[seq == 2] = "busy", "refused"
            return pd.DataFrame({"raw_response": "1", "error": error, "retryable": again})

    got = answers(
        score(
            wanted(spark, "abcd").coalesce(1),
            Flaky(folder, lambda seq, run: True),
            max_tries=max_tries,
        )
    )
    assert got[0][1] == "busy" and got[2][1] == "refused" and got[3] == ("1", None)
    assert got[1][1] == (None if max_tries > 1 else "busy")
    tries = {seq: sum(1 for t in trace(folder) if t[2] == seq) for seq in range(4)}
    assert tries == {0: max_tries, 1: min(max_tries, 2), 2: 1, 3: 1}


def test_one_call_per_row_whatever_is_selected(spark, tmp_path):
    scored = score(wanted(spark, "abcdefgh"), TracingScorer(tmp_path, lambda seq, run: True))
    scored.where(~responses.has_error()).where(responses.answer_is_valid()).select(
        "raw_response", "error", responses.parse_prediction(), responses.parse_reason()
    ).collect()
    assert [t[2] for t in trace(tmp_path)] == list(range(8))


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_in_order(spark, tmp_path, batch):
    """Groups stop at their first valid answer, also where Arrow batches cut them."""
    keys = [f"k{i * i % 13}" for i in range(120)]

    def rule(seq, run):
        return seq % 9 == 4

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = score_in_order(
            wanted(spark, keys), TracingScorer(tmp_path, rule), ["model", "key_hash"], tasks=3
        )
        seqs = sorted(r.seq for r in got.select("seq").collect())
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    _, asked = one_by_one(keys, rule)
    assert seqs == asked
    assert [t[2] for t in trace(tmp_path)] == asked


def test_only_prompts_go_to_python(spark):
    scored = score(wanted(spark, ["a"]), TracingScorer("/tmp", None))
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan
    assert scored.columns[-2:] == ["raw_response", "error"]


def batch(n):
    columns = ["model", "model_id", "seq", "system_prompt", "user_prompt", "try_no"]
    return pd.DataFrame([("m", "id", i, "s", str(i), 1) for i in range(n)], columns=columns, index=range(100, 100 + n))


@pytest.mark.parametrize("n", [1, 3, 8])
def test_so_many_calls_are_in_flight(n):
    lock, most, now = threading.Lock(), 0, 0

    def call(model_id, system, user):
        nonlocal most, now
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.01 * (1 + int(user) % 3))
        with lock:
            now -= 1
        if int(user) % 5 == 0:
            raise RateLimited
        return user

    asked = batch(40)
    got = row_scorer(call, in_flight=n)(asked)
    assert most == n
    assert list(got.index) == list(asked.index)
    assert list(got["raw_response"]) == ["" if i % 5 == 0 else str(i) for i in range(40)]
    assert list(got["retryable"]) == [i % 5 == 0 for i in range(40)]
    assert row_scorer(call, in_flight=n)(batch(0)).empty
    with pytest.raises(ValueError, match="at least 1"):
        row_scorer(call, in_flight=0)


def test_calls_in_flight_keep_the_order_of_a_key(spark, tmp_path):
    """The calls are those of the row-by-row loop, each key's in input order."""
    keys, folder = [f"k{i % 7}" for i in range(70)], str(tmp_path)

    def call(model_id, system, user):
        with open(f"{folder}/{time.time_ns()}-{threading.get_ident()}", "w") as trace:
            trace.write(user)
        return "PREDICTION: 1" if user.count("!") else "cannot tell"

    rows = rows_table(spark, keys)
    marked = rows.withColumn("drug_name", F.concat(F.lit("d"), "seq", F.when(F.col("seq") % 9 == 4, "!").otherwise("-")))
    got = score_in_order(fan_out(marked, QWEN), row_scorer(call, in_flight=4), ["model", "key_hash"], tasks=2)
    seqs = sorted(r.seq for r in got.select("seq").collect())
    _, asked = one_by_one(keys, lambda seq, run: seq % 9 == 4)
    assert seqs == asked and len(list(tmp_path.iterdir())) == len(asked)
    order = {}
    for path in sorted(tmp_path.iterdir(), key=lambda p: int(p.name.split("-")[0])):
        seq = int(re.search(r"\bd(\d+)[-!]", path.read_text()).group(1))
        order.setdefault(keys[seq], []).append(seq)
    assert all(found == sorted(found) for found in order.values())
