"""A resumable run: ask the models for what the log does not hold yet."""

import warnings
from functools import partial

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from criteria_engine.fixed_values import MAX_TRIES, MODELS
from criteria_engine.operators.bloom import held_back
from criteria_engine.operators.keyed import SLOT, answered_keys, pending_heads
from criteria_engine.operators.models import model_id
from criteria_engine.operators.scoring import Scorer, score, score_in_order
from criteria_engine.sources.attempts import append_answers, attempt_number, read_attempts
from criteria_engine.sources.segments import MERGE_RUNS, compact, last_run, read_runs, stored_runs, stored_tries
from criteria_engine.sources.texts import add_texts
from criteria_engine.storage import discard, shared_folder, store

# Rows of one key in the first chunk behind its head, and how often chunks double.
CHUNK_ROWS = 256
DOUBLINGS = 8

# Rows per scoring task.
TASK_ROWS = 2_000


def run_models(
    rows: DataFrame,
    log_path: str,
    scorer: Scorer,
    models=MODELS,
    *,
    tasks: int | None = None,
    chunk_rows: int = CHUNK_ROWS,
    max_tries: int = MAX_TRIES,
    merge_runs: int = MERGE_RUNS,
    run_no: int | None = None,
    folder: str | None = None,
) -> int:
    """One run over numbered annotations (`seq`, `key_hash`, `text_hash`); returns its run number.

    Keys with a valid answer in the log are skipped. Within the run the rows of a
    key are asked in input order until one answer is valid.

    First every open key is asked once, with its first row. The remaining rows of
    keys that failed are ranked and cut into chunks, of `chunk_rows` at first and of
    twice as many each time, up to DOUBLINGS times; then they stay as long. A wave asks
    one chunk of every key that is still open, row by row, so calls are those of a
    row-by-row loop for every key. A task's answers are in the log when the task ends:
    a crash costs what its running tasks had asked. Whole rows are scanned for the heads, for
    chunk 0 and once for all later chunks. Before rows are asked, their sentences are stored where the log
    does not hold them; only new ones are read for that. Rows behind chunk 0 may turn out not to be asked.

    `tasks` sets the number of scoring tasks, and so how many calls are in flight at
    most; by default it follows the number of rows to ask. Where the log has `merge_runs`
    runs that are not merged, they are merged first.

    `run_no` starts that run again, which must be the log's last: what it has answered stays,
    and the rest is asked as if for the first time. `folder` is where the run's steps are stored.
    """
    spark = rows.sparkSession
    if spark.conf.get("spark.speculation", "false") == "true":
        warnings.warn("spark.speculation is on: copies of slow tasks repeat their calls")
    folder = folder or shared_folder(spark)
    last = last_run(spark, log_path)
    if run_no is not None and run_no < last:
        raise ValueError(f"run {last} came after run {run_no}")
    if run_no is None or run_no > last:
        compact(spark, log_path, merge_runs)
    run_no = last + 1 if run_no is None else run_no
    tries = stored_tries(spark, log_path, run_no)
    save = partial(_save, run_no=run_no, log_path=log_path, try_no=max(tries, default=-1) + 1)

    try:
        _ask_open_keys(rows, read_attempts(spark, log_path, rows, texts=False), run_no, folder, scorer, models, save, log_path, tasks, chunk_rows, max_tries)
    finally:
        discard(spark, folder)
    return run_no


def _ask_open_keys(rows, log, run_no, folder, scorer, models, save, log_path, tasks, chunk_rows, max_tries) -> None:
    spark = rows.sparkSession
    heads, found = store(
        pending_heads(rows, log, models), f"{folder}/heads", asks=F.sum(F.size("open_models"))
    )
    if not found["n"]:
        return
    add_texts(rows, log_path, asked=_digests(rows, heads))
    asks = _head_rows(rows, heads, found["n"], tasks or _tasks(spark, found["asks"]), models)
    save(score(asks, scorer, max_tries))

    failed, found = store(_failed(_this_run(spark, log_path, run_no)), f"{folder}/failed")
    if not found["n"]:
        return
    ranked, found = _ranked(_behind(rows, failed), folder, chunk_rows)
    if not found["n"]:
        return

    def ask_in_order(asks: DataFrame, size: int) -> None:
        asks = asks.select(*rows.columns, F.explode("models").alias("model"))
        asks = asks.withColumn("model_id", model_id(models))
        save(score_in_order(asks, scorer, SLOT, tasks or _tasks(spark, size), max_tries))

    nearest = ranked.where("chunk = 0")
    add_texts(rows, log_path, asked=_digests(rows, nearest))
    ask_in_order(_whole(rows, nearest), found["n"])
    if not found["last"]:
        return

    # Keys that chunk 0 did not answer. Their whole rows are picked once, for all waves.
    open_keys = ranked.where("chunk = 1").select(*SLOT).distinct()
    answered = answered_keys(_this_run(spark, log_path, run_no))
    keys, counted = store(open_keys.join(answered, SLOT, "left_anti"), f"{folder}/keys_1")
    if not counted["n"]:
        return
    open_rows = ranked.where("chunk > 0").join(keys, SLOT, "left_semi")
    later, found = store(_whole(rows, open_rows), f"{folder}/later", by=["chunk"], last=F.max("chunk"))
    add_texts(later, log_path)
    for wave in range(1, found["last"] + 1):
        if wave > 1:
            answered = answered_keys(_this_run(spark, log_path, run_no))
            keys, counted = store(keys.join(answered, SLOT, "left_anti"), f"{folder}/keys_{wave}")
        if not counted["n"]:
            return
        still = keys.groupBy("key_hash").agg(F.collect_set("model").alias("open"))
        asks = later.where(F.col("chunk") == wave).join(still, "key_hash")
        asks = asks.withColumn("models", F.array_intersect("models", "open"))
        ask_in_order(asks, counted["n"] * chunk_rows * 2 ** min(wave, DOUBLINGS))


def _digests(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """Number and text digest of the rows to ask; no sentence moves for it."""
    return rows.select("seq", "text_hash").join(asks.select("seq"), "seq", "left_semi")


def _tasks(spark: SparkSession, calls: int) -> int:
    """Enough tasks that a lost one repeats few calls."""
    return max(spark.sparkContext.defaultParallelism, -(-calls // TASK_ROWS))


def _save(answers: DataFrame, run_no: int, log_path: str, try_no: int) -> None:
    append_answers(
        answers.withColumns(
            {"run_no": F.lit(run_no), "attempt_no": attempt_number(run_no)}
        ),
        log_path,
        try_no,
    )


def _this_run(spark: SparkSession, log_path: str, run_no: int) -> DataFrame:
    """What the run has asked so far, read from its own folder."""
    return read_runs(spark, log_path, [n for n in stored_runs(spark, log_path) if n == run_no])


def _head_rows(rows: DataFrame, heads: DataFrame, n: int, tasks: int, models) -> DataFrame:
    """Whole rows to ask, in `tasks` partitions, once per open model.

    The `n` heads are a stored table, so Spark knows its bytes and sends it to the rows where
    that is cheaper; then only requested rows move. Where it is not, both sides are
    shuffled, and a Bloom filter of the heads holds back nearly all other rows before that.
    A row is repeated per model, and grown into a prompt, behind the shuffle.
    """
    found = held_back(rows, heads, "seq", n).join(heads.drop("key_hash"), "seq").repartition(tasks, "seq")
    asks = found.select(*rows.columns, F.explode("open_models").alias("model"))
    return asks.withColumn("model_id", model_id(models))


def _whole(rows: DataFrame, asks: DataFrame) -> DataFrame:
    """Whole rows for a table of (model, key_hash, seq, chunk), each once, with its `models`.

    A row has the same chunk for all models, as they share its key's head.
    """
    asked = asks.groupBy("seq", "chunk").agg(F.collect_set("model").alias("models"))
    return rows.join(asked, "seq")


def _failed(asked: DataFrame) -> DataFrame:
    """Keys whose first row got no valid answer, with that row's number."""
    return asked.where(~F.col("answered")).select(*SLOT, F.col("seq").alias("head"))


def _behind(rows: DataFrame, failed: DataFrame) -> DataFrame:
    """The rows that follow the failed first row of their key."""
    return (
        rows.select("seq", "key_hash")
        .join(failed, "key_hash")
        .where(F.col("seq") > F.col("head"))
        .select(*SLOT, "seq")
    )


def _ranked(rows: DataFrame, folder: str, chunk_rows: int) -> tuple[DataFrame, dict]:
    """Number each key's rows in `seq` order, in chunks, without gathering a key in one task.

    Range partitioning cuts through large keys; a row's rank is its rank within the
    part plus the size of the key's earlier parts. Also returns the number of rows
    `n` and the `last` chunk, -1 without rows.
    """
    parts, found = store(
        rows.repartitionByRange(*SLOT, "seq").withColumn("part", F.spark_partition_id()),
        f"{folder}/parts",
    )
    if not found["n"]:
        return rows.withColumn("chunk", F.lit(0)), {"n": 0, "last": -1}
    within = Window.partitionBy(*SLOT, "part").orderBy("seq")
    earlier = Window.partitionBy(*SLOT).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parts.groupBy(*SLOT, "part").agg(F.count("*").alias("size"))
    before = sizes.select(
        *SLOT, "part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before")
    )
    rank = F.col("before") + F.col("row") - 1
    unit = F.floor(rank / chunk_rows)
    doubled = 2 ** (DOUBLINGS + 1) - 1
    chunk = F.when(unit < doubled, F.length(F.bin(unit + 1)) - 1).otherwise(
        F.floor((unit - doubled) / 2**DOUBLINGS) + DOUBLINGS + 1
    )
    return store(
        parts.withColumn("row", F.row_number().over(within))
        .join(before, [*SLOT, "part"])
        .select(*SLOT, "seq", chunk.cast("int").alias("chunk")),
        f"{folder}/ranked",
        last=F.max("chunk"),
    )
