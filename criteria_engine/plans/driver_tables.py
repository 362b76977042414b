"""Annotations and model answers derived from the driver's `documents` and `labels`.

Each document gives two annotations with one result key: its own source is the
first drug, another source the second; the gold labels are `quality` and `toxic`.
The sentence is the whole document text. Answers come in eleven shapes, chosen by
row, model and try.
"""

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from criteria_engine.fixed_values import MODELS, RATE_LIMIT_ERROR
from criteria_engine.functions.responses import answer_is_valid
from criteria_engine.functions.text import key_hash, text_hash
from criteria_engine.operators.keyed import calls_needed, pending_rows
from criteria_engine.operators.lines import type_fields
from criteria_engine.operators.models import fan_out
from criteria_engine.schemas import ATTEMPTS, LOGGED, ROWS
from criteria_engine.sources.attempts import append_attempts, attempt_number, read_attempts
from criteria_engine.sources.texts import with_texts
from criteria_engine.storage import shared_folder

# Answer texts by shape; shape 7 is a rate limit.
SHAPES = (
    "PREDICTION: 1\nREASON: requires prior exposure",
    "PREDICTION: 0\nREASON: strict exclusion\nextra line",
    "prediction:  1\nreason:   lower case",
    "**PREDICTION:** 0 maybe 1",
    "I think the answer is 1.",
    "cannot tell",
    "",
    "",
    "PREDICTION: unknown\nREASON: Phase 1 trial",
    "PREDICTION:\xa00",
    "PREDICTION: 10",
)
RATE_LIMITED = 7

# The columns used of the driver's tables.
DOCUMENTS = "doc_id bigint, text string, source string"
LABELS = "doc_id bigint, quality int, toxic int"

# Drug files before this name were answered by the first run.
FIRST_RUN_BEFORE = "src15"


def annotations(spark: SparkSession, sf_dir: str, labels_join: str = "left") -> DataFrame:
    """seq and the five raw fields of an annotation line; without labels they are invalid."""
    documents = spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.schema(LABELS).parquet(f"{sf_dir}/labels.parquet")
    doc, first = F.col("doc_id"), F.col("k") == 0
    other = F.concat(F.lit("src"), ((doc + 7) % 20).cast("string"))
    return (
        documents.join(labels, "doc_id", labels_join)
        .select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
        .select(
            (2 * doc + F.col("k")).alias("seq"),
            F.concat(
                F.when(doc % 29 == 0, "misc_").otherwise("annot-NOT_prior_therapy_"),
                F.when(first, F.col("source")).otherwise(other),
                F.lit(".txt"),
            ).alias("source_file"),
            F.when(first, F.coalesce(F.col("quality").cast("string"), F.lit("NA")))
            .otherwise(F.coalesce(F.col("toxic").cast("string"), F.lit("")))
            .alias("raw_label"),
            F.concat(F.lit("NCT"), F.lpad(F.expr("doc_id div 8").cast("string"), 8, "0")).alias(
                "trial_id"
            ),
            F.element_at(F.array(*map(F.lit, ("INCL", "EXCL", "incl"))), (doc % 3 + 1).cast("int"))
            .alias("section"),
            F.trim(F.replace(F.col("text"), F.lit("\n"), F.lit(" "))).alias("criteria_text"),
        )
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq and annotation lines, some of them blank, short, shifted or padded."""
    fields = ["source_file", "raw_label", "trial_id", "section", "criteria_text"]
    whole = F.concat_ws("\t", *fields)
    padded = F.concat(F.lit("\xa0 "), F.col("raw_label"), F.lit(" "))
    case = F.col("seq") % 13
    return annotations(spark, sf_dir).select(
        "seq",
        F.when(case == 0, F.lit(" \xa0\t "))
        .when(case == 1, F.concat_ws("\t", *fields[:4]))
        .when(case == 2, F.concat(F.lit("\t"), whole, F.lit("\t")))
        .when(case == 3, F.concat(whole, F.lit("\tnote\tmore")))
        .when(case == 4, F.concat_ws("\t", "source_file", padded, *fields[2:]))
        .when(case == 5, F.concat_ws("\t", F.concat("source_file", F.lit(".bak")), *fields[1:]))
        .otherwise(whole)
        .alias("line"),
    )


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid annotations: seq, typed columns, digests of key and text."""
    # an inner join: unlabelled documents, which have no valid annotation, are not moved
    labelled = annotations(spark, sf_dir, "inner")
    return type_fields(labelled).withColumns({"key_hash": key_hash(), "text_hash": text_hash()})


# Folders of derived tables, by application, input and name.
_folders: dict[tuple, str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Folder of a derived table, written once per application."""
    place = (spark.sparkContext.applicationId, sf_dir, name)
    if place not in _folders:
        folder = shared_folder(spark)
        write(folder)
        _folders[place] = folder
    return _folders[place]


def staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`rows`, stored, so that key operators read no text."""

    def write(folder):
        rows(spark, sf_dir).write.parquet(folder)

    return spark.read.schema(ROWS).parquet(_stored(spark, sf_dir, "rows", write))


def log_folder(spark: SparkSession, sf_dir: str) -> str:
    """The attempts log after two runs, as it is stored."""

    def write(folder):
        whole = staged(spark, sf_dir)
        append_attempts(prior(spark, sf_dir), folder, rows=whole)
        first = read_attempts(spark, folder, texts=False)
        append_attempts(_second(spark, sf_dir, first), folder, rows=whole)

    return _stored(spark, sf_dir, "log", write)


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The attempts log after two runs, with digests in place of the sentences."""
    return read_attempts(spark, log_folder(spark, sf_dir), texts=False)


def texts(spark: SparkSession, sf_dir: str, attempts: DataFrame) -> DataFrame:
    """Rows of `log` with their sentences."""
    return with_texts(spark, log_folder(spark, sf_dir), attempts)


def answers(asked: DataFrame, run_no: int = 1, shift: int = 0) -> DataFrame:
    """Attempts for rows that carry `ord` and `model`; as they are logged if the rows have no sentence."""
    columns = LOGGED if "criteria_text" not in asked.columns else ATTEMPTS
    answered = asked.withColumn("_shape", _shape(shift)).select(
        "model",
        F.lit(run_no).alias("run_no"),
        attempt_number(run_no).alias("attempt_no"),
        *[name for name in ROWS.names if name in asked.columns],
        F.element_at(F.array(*map(F.lit, SHAPES)), F.col("_shape") + 1).alias("raw_response"),
        F.when(F.col("_shape") == RATE_LIMITED, RATE_LIMIT_ERROR).alias("error"),
    )
    return answered.withColumn("answered", answer_is_valid()).select(*columns.names)


def _shape(shift: int = 0) -> Column:
    return ((F.col("seq") + 3 * F.col("ord") + shift) % len(SHAPES)).cast("int")


def resp(spark: SparkSession, sf_dir: str, models=MODELS) -> DataFrame:
    """One answer per valid annotation and model."""
    return answers(fan_out(rows(spark, sf_dir), models))


def keyed_resp(spark: SparkSession, sf_dir: str, models=MODELS) -> DataFrame:
    """`resp` over the stored rows."""
    return answers(fan_out(staged(spark, sf_dir), models))


def prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a first run over some of the drug files stored, with digests in place of the sentences."""
    seen = staged(spark, sf_dir).drop("criteria_text").where(F.col("drug_name") < FIRST_RUN_BEFORE)
    return calls_needed(answers(fan_out(seen)))


def _second(spark: SparkSession, sf_dir: str, first: DataFrame) -> DataFrame:
    """What the next run, over all files, adds."""
    pending = pending_rows(fan_out(staged(spark, sf_dir).drop("criteria_text")), first)
    return calls_needed(answers(pending, run_no=2))


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, model and response bodies, good and broken, that hold the answers."""
    case = (F.col("seq") + 3 * F.col("ord")) % len(SHAPES)
    shaped = fan_out(rows(spark, sf_dir)).select(
        "seq",
        "model",
        case.alias("case"),
        F.element_at(F.array(*map(F.lit, SHAPES)), case.cast("int") + 1).alias("text"),
    )
    content = F.concat(F.lit("\n"), F.col("text"), F.lit("\xa0"))
    body = F.to_json(
        F.struct(
            F.array(
                F.struct(F.struct(content.alias("content")).alias("message")),
            ).alias("choices")
        )
    )
    even = F.col("seq") % 2 == 0
    return shaped.select(
        "seq",
        "model",
        F.when(F.col("case") == 5, F.when(even, "upstream timeout").otherwise('{"choices":[]}'))
        .when(F.col("case") == 6, F.when(even, "{}").otherwise('{"choices":[{}]}'))
        .when(
            F.col("case") == RATE_LIMITED,
            F.when(even, '{"choices":[{"error":{"message":"Max retries exceeded"}}]}').otherwise(
                '{"choices":[{"error":{"code":5}}]}'
            ),
        )
        .when(
            F.col("case") == 8,
            F.when(even, '{"choices":[{"message":{"content":null}}]}').otherwise(
                '{"choices":[{"error":"overloaded"}]}'
            ),
        )
        .otherwise(body)
        .alias("body"),
    )


def text_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq and answers that are, or hold, a whole document text."""
    documents = spark.read.schema(DOCUMENTS).parquet(f"{sf_dir}/documents.parquet")
    case, text = F.col("doc_id") % 4, F.col("text")
    return documents.select(
        F.col("doc_id").alias("seq"),
        F.when(case == 0, text)
        .when(case == 1, F.concat(F.lit("Reason: "), text))
        .when(case == 2, F.concat(text, F.lit("\nPREDICTION: 0\nREASON:\n"), text))
        .otherwise(F.concat(F.lit("PREDICTION: 1\n"), text))
        .alias("raw_response"),
    )


def prompt_call(model_id: str, system: str, user: str) -> str:
    """An answer that only the whole prompt gives: its length and digest."""
    digest = hashlib.md5(user.encode(), usedforsecurity=False).hexdigest()
    return f"PREDICTION: {len(user) % 2}\nREASON: {len(system)} {digest}"


def accent_call(model_id: str, system: str, user: str) -> str:
    """An answer by the accents of the sentence."""
    return f"PREDICTION: {user.count('é') % 2}"


# Rows of these numbers, modulo LATE_STEP, get a valid answer from `late_scorer`.
LATE_STEP, LATE_ROW = 64, 5


def late_scorer(requests: pd.DataFrame) -> pd.DataFrame:
    """A model that mostly gives no valid answer."""
    valid = requests["seq"] % LATE_STEP == LATE_ROW
    texts = valid.map({True: "PREDICTION: 1", False: "cannot tell"})
    return pd.DataFrame({"raw_response": texts, "error": None, "retryable": False})


def rule_scorer(shift: int = 0, step: int = 4):
    """Scorer that gives the answers above; each further try moves on by `step` shapes."""
    order = {name: i for i, (name, _) in enumerate(MODELS)}

    def score_batch(requests: pd.DataFrame) -> pd.DataFrame:
        moved = shift + step * (requests["try_no"] - 1)
        shape = (requests["seq"] + 3 * requests["model"].map(order) + moved) % len(SHAPES)
        limited = shape == RATE_LIMITED
        return pd.DataFrame(
            {
                "raw_response": shape.map(dict(enumerate(SHAPES))),
                "error": limited.map({True: RATE_LIMIT_ERROR, False: None}),
                "retryable": limited,
            }
        )

    return score_batch
