"""The attempts log, and stored result files that are taken over into it."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from criteria_engine.functions.responses import answer_is_valid, parse_prediction
from criteria_engine.functions.text import key_hash, text_hash
from criteria_engine.schemas import KEY, LOGGED, SEQ_BITS
from criteria_engine.sources.segments import read_log
from criteria_engine.sources.texts import add_texts, with_texts
from criteria_engine.storage import shared_folder, store


def read_attempts(spark: SparkSession, path: str, near: DataFrame | None = None, texts: bool = True) -> DataFrame:
    """The log, or an empty table with its columns if there is none yet.

    Merged runs have one row per (model, key), their current result; later ones have all
    attempts. With `near`, only what may concern the keys of its rows is sure to be there. Without
    `texts` a digest (`text_hash`) stands for `criteria_text`, and the sentences are not read.
    """
    logged = read_log(spark, path, near)
    return with_texts(spark, path, logged) if texts else logged


def append_attempts(attempts: DataFrame, path: str, try_no: int = 0, rows: DataFrame | None = None) -> None:
    """Add attempts (ATTEMPTS) to the log: sentences that it does not hold yet, then the attempts.

    `attempts` are computed more than once; of answers as they are asked for, store the
    sentences first, then `append_answers`. With `rows` (ROWS) the attempts (LOGGED) hold digests
    only, and the sentences are taken from their rows.
    """
    if rows is not None:
        add_texts(rows, path, asked=attempts)
        append_answers(attempts, path, try_no)
        return
    hashed = attempts.withColumns({"text_hash": text_hash(), "_row": F.xxhash64("model", "attempt_no")})
    add_texts(hashed, path, "_row")
    append_answers(hashed, path, try_no)


def append_answers(attempts: DataFrame, path: str, try_no: int = 0) -> None:
    """Add attempts whose sentences are stored, one folder per run, start of the run, and model.

    Nothing stored is rewritten. A task's answers are in the log as soon as the task ends, so
    they outlive a job that breaks later.
    """
    marked = attempts.withColumn("answered", answer_is_valid())
    marked.select(*LOGGED.names, F.lit(try_no).alias("try_no")).write.mode("append").option(
        "mapreduce.fileoutputcommitter.algorithm.version", "2"
    ).partitionBy("run_no", "try_no", "model").parquet(f"{path}/runs")


def attempt_number(run_no, seq="seq"):
    """Rises with the run, then with input order."""
    place = F.when(F.col(seq).between(0, 2**SEQ_BITS - 1), F.col(seq)).otherwise(
        F.raise_error(F.lit("row number out of range")).cast("bigint")
    )
    return F.shiftleft(F.lit(run_no).cast("bigint"), SEQ_BITS) + place


def next_run(attempts: DataFrame) -> int:
    return (attempts.agg(F.max("run_no")).first()[0] or 0) + 1


def _numbered(rows: DataFrame) -> DataFrame:
    """`seq` from 0 without gaps, in the order of the input's splits.

    Rows are stored with their row ids; each partition then starts behind the rows of the
    earlier ones, so one row per partition is ordered globally.
    """
    part = F.shiftright("row_id", 33)
    rows, _ = store(rows, f"{shared_folder(rows.sparkSession)}/imported")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    place = F.col("row_id").bitwiseAND(2**33 - 1)
    return rows.join(before, part == F.col("part")).select(
        (F.col("before") + place).alias("seq"), *[c for c in rows.columns if c != "row_id"]
    )


def read_results_csv(
    spark: SparkSession, path, model: str, run_no: int | None = None, key=KEY, log: DataFrame | None = None
) -> DataFrame:
    """A model's result CSV (annotation columns, llm_prediction, llm_reason) as attempts.

    The stored prediction decides: a row without a 0 or 1 in it counts as failed, whatever
    digits its reason holds. The answer text is rebuilt so that it parses back to the
    stored prediction and reason: a reason of several lines was the whole answer, any
    other was the `REASON:` line; a failed row keeps its reason where no digit can be
    read from it, else it is an error with the reason as its text. `run_no` must be free
    in `log`; by default it is the next one there (1 without a log). Quoted texts may
    hold line breaks, so each file is read by one task.
    """
    taken = set()
    if log is not None:
        taken = {r[0] for r in log.select("run_no").distinct().collect()}
    run_no = max(taken, default=0) + 1 if run_no is None else run_no
    if run_no in taken:
        raise ValueError(f"run {run_no} is in the log")
    columns = "drug_name string, label string, trial_id string, section string, " + (
        "criteria_text string, llm_prediction string, llm_reason string"
    )
    stored = _numbered(
        spark.read.schema(columns)
        .option("header", True)
        .option("multiLine", True)
        .option("escape", '"')
        .csv(path)
        .withColumn("row_id", F.monotonically_increasing_id())
        .na.fill("")
    )
    value = F.expr("try_cast(llm_prediction as double)")
    valid = F.coalesce(value.isin(0.0, 1.0), F.lit(False))
    reason = F.col("llm_reason")
    error = F.when(reason.startswith("ERROR: "), F.substring(reason, len("ERROR: ") + 1, 2**31 - 1))
    error = error.when(parse_prediction(reason).isNotNull(), reason)
    rebuilt = F.concat(
        F.lit("PREDICTION: "), value.cast("int").cast("string"), F.lit("\nREASON: "), reason
    )
    # an answer of several lines stays whole, unless it reads as another prediction
    same = reason.contains("\n") & F.coalesce(parse_prediction(reason) == value.cast("int"), F.lit(False))
    answer = F.when(valid, F.when(same, reason).otherwise(rebuilt))
    taken_over = stored.select(
        F.lit(model).alias("model"),
        F.lit(run_no).alias("run_no"),
        attempt_number(run_no).alias("attempt_no"),
        "seq",
        key_hash(key).alias("key_hash"),
        "drug_name",
        F.expr("try_cast(label as int)").alias("label"),
        "trial_id",
        "section",
        "criteria_text",
        answer.when(error.isNotNull(), "").otherwise(reason).alias("raw_response"),
        F.when(~valid, error).alias("error"),
    )
    return taken_over.withColumn("answered", answer_is_valid())
