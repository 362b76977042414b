"""Score rows with a model through Arrow batches.

A scorer is a picklable callable from a pandas batch of requests to a pandas batch
of answers, row for row:

    requests: model, model_id, seq, system_prompt, user_prompt, try_no
    answers:  raw_response, error (None if the call went through), retryable

Only prompts travel to the Python workers and only answers come back; the other
columns stay in the JVM. Every request is a paid call, so store what `score`
returns in one action before using it.
"""

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from criteria_engine.fixed_values import MAX_TRIES, RATE_LIMIT_ERROR, SYSTEM_PROMPT
from criteria_engine.functions.prompts import user_prompt

Scorer = Callable[[pd.DataFrame], pd.DataFrame]

# What travels to the workers; the system prompt is the same for all rows and is added there.
_SENT = ["model", "model_id", "seq", "user_prompt"]
_REQUEST = ["model", "model_id", "seq", "system_prompt", "user_prompt"]
_ANSWER = ["raw_response", "error", "retryable"]


class RateLimited(Exception):
    """Raised by a call that was turned away and may be tried again."""


def row_scorer(call: Callable[[str, str, str], str], retry_on=(OSError,), in_flight: int = 1) -> Scorer:
    """Scorer from a single call (model_id, system_prompt, user_prompt) -> answer text.

    A task has up to `in_flight` calls open at a time; `call` must then bear several threads. The
    requests of a batch do not depend on each other, as a batch of `score_in_order` has one row
    of each key, so the calls of a run are the same for any number.

    Failures become data: a rate limit or transport error (`retry_on`) may be tried
    again, any other exception is an error row at once.
    """

    if in_flight < 1:
        raise ValueError(f"calls in flight must be at least 1: {in_flight}")

    def ask(request) -> tuple:
        try:
            text = call(request.model_id, request.system_prompt, request.user_prompt)
            return text.strip(), None, False
        except RateLimited:
            return "", RATE_LIMIT_ERROR, True
        except retry_on as failure:
            return "", str(failure), True
        except Exception as failure:
            return "", str(failure) or type(failure).__name__, False

    def score_batch(requests: pd.DataFrame) -> pd.DataFrame:
        each = requests.itertuples(index=False)
        if in_flight == 1 or len(requests) < 2:
            answers = [ask(request) for request in each]
        else:
            with ThreadPoolExecutor(min(in_flight, len(requests))) as window:
                answers = list(window.map(ask, each))  # in the order of the requests
        return pd.DataFrame(answers, columns=_ANSWER, index=requests.index)

    return score_batch


def _ask(scorer: Scorer, requests: pd.DataFrame, max_tries: int) -> pd.DataFrame:
    """Answers for a batch; only retryable rows go back to the scorer."""
    answers, open_rows = None, requests
    for try_no in range(1, max_tries + 1):
        got = scorer(open_rows.assign(try_no=try_no))[_ANSWER].set_axis(open_rows.index)
        if answers is None:
            answers = got.astype(object)
        else:
            answers.loc[open_rows.index] = got.astype(object)
        open_rows = open_rows[got["retryable"].to_numpy(dtype=bool)]
        if open_rows.empty:
            break
    return answers


def _valid(answers: pd.DataFrame) -> pd.Series:
    """A parsable answer: no error, and a 0 or 1 in the text."""
    failed = answers["error"].notna() & (answers["error"] != "")
    return ~failed & answers["raw_response"].fillna("").astype(str).str.contains("[01]")


def _sent() -> list[Column]:
    return [user_prompt() if name == "user_prompt" else F.col(name) for name in _SENT]


def _requests(columns: tuple[pd.Series, ...]) -> pd.DataFrame:
    return pd.concat(columns, axis=1, keys=_SENT).assign(system_prompt=SYSTEM_PROMPT)[_REQUEST]


def score(rows: DataFrame, scorer: Scorer, max_tries: int = MAX_TRIES) -> DataFrame:
    """Add `raw_response` and `error` to every row; rows are asked independently."""

    def answer(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            requests = _requests(columns)
            yield _ask(scorer, requests, max_tries)[["raw_response", "error"]]

    # non-deterministic: the optimizer must neither repeat the call nor move filters past it
    asked = F.pandas_udf(_typed(answer), "raw_response string, error string").asNondeterministic()
    return rows.withColumn("_answer", asked(*_sent())).select(
        *rows.columns, "_answer.raw_response", "_answer.error"
    )


def score_in_order(
    rows: DataFrame, scorer: Scorer, by, tasks: int, max_tries: int = MAX_TRIES
) -> DataFrame:
    """Like `score`, but asks each group `by` in `seq` order and stops at its first valid answer.

    Rows that were not asked are left out. The groups of an Arrow batch advance
    together, one open row of each per call to the scorer.
    """
    by = list(by)

    def answer(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        last, last_done = None, False
        for columns in batches:
            requests = _requests(columns[: len(_SENT)])
            groups = pd.concat(columns[len(_SENT) :], axis=1).to_numpy(dtype=object)
            # rows are sorted: a group is a run of rows, and may go on from the last batch
            starts = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]).any(axis=1)])
            sizes = np.diff(np.r_[starts, len(groups)])
            done = np.zeros(len(starts), dtype=bool)
            done[0] = last_done and last == tuple(groups[0])
            raw, error = (np.full(len(groups), None, dtype=object) for _ in range(2))
            asked = np.zeros(len(groups), dtype=bool)
            step, turn = 0, np.flatnonzero(~done)
            while len(turn):
                at = starts[turn] + step
                got = _ask(scorer, requests.iloc[at], max_tries)
                raw[at], error[at], asked[at] = got["raw_response"], got["error"], True
                done[turn] = _valid(got)
                step += 1
                turn = turn[~done[turn] & (sizes[turn] > step)]
            last, last_done = tuple(groups[-1]), done[-1]
            yield pd.DataFrame({"raw_response": raw, "error": error, "asked": asked})

    asked = F.pandas_udf(
        _typed(answer), "raw_response string, error string, asked boolean"
    ).asNondeterministic()
    placed = rows.repartition(tasks, *by).sortWithinPartitions(*by, "seq")
    return (
        placed.withColumn("_answer", asked(*_sent(), *by))
        .where("_answer.asked")
        .select(*rows.columns, "_answer.raw_response", "_answer.error")
    )


def _typed(answer):
    """The hints by which pandas_udf recognises an iterator of column batches."""
    answer.__annotations__ = {
        "batches": Iterator[tuple[pd.Series, ...]],
        "return": Iterator[pd.DataFrame],
    }
    return answer
