"""Explicit table schemas; nothing is inferred."""

from pyspark.sql import types as T

# Place of a line in its input: file path, start of the split, row id.
ORDER = ("src_file", "src_block", "src_row")

# An attempt's key: rows that agree on these columns share one answer.
KEY = ("trial_id", "criteria_text")

ANNOTATION_COLUMNS = ("drug_name", "label", "trial_id", "section", "criteria_text")

ANNOTATION = T.StructType(
    [
        T.StructField("drug_name", T.StringType()),
        T.StructField("label", T.IntegerType()),
        T.StructField("trial_id", T.StringType()),
        T.StructField("section", T.StringType()),
        T.StructField("criteria_text", T.StringType()),
    ]
)

# Annotations stored once per input, with input order and digests of key and text.
STAGED = T.StructType(
    [
        T.StructField("src_file", T.StringType()),
        T.StructField("src_block", T.LongType()),
        T.StructField("src_row", T.LongType()),
        T.StructField("key_hash", T.BinaryType()),
        T.StructField("text_hash", T.BinaryType()),
        *ANNOTATION.fields,
    ]
)

# Numbered annotations, the input of a run.
ROWS = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        *ANNOTATION.fields,
        T.StructField("key_hash", T.BinaryType()),
        T.StructField("text_hash", T.BinaryType()),
    ]
)

# The append-only log of model answers. `attempt_no` rises over runs and, within
# a run, in input order, and is unique per model. `answered` says that the answer
# parses to a prediction, so that key operators need not read answer texts.
ATTEMPTS = T.StructType(
    [
        T.StructField("model", T.StringType()),
        T.StructField("run_no", T.IntegerType()),
        T.StructField("attempt_no", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("key_hash", T.BinaryType()),
        *ANNOTATION.fields,
        T.StructField("raw_response", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("answered", T.BooleanType()),
    ]
)

# Attempts as they are stored: the sentence's digest stands for the sentence.
LOGGED = T.StructType(
    [T.StructField("text_hash", T.BinaryType()) if f.name == "criteria_text" else f for f in ATTEMPTS.fields]
)

# Sentences, each stored once.
TEXTS = T.StructType(
    [
        T.StructField("text_hash", T.BinaryType()),
        T.StructField("criteria_text", T.StringType()),
    ]
)

# One model's stored results as a CSV with a header.
RESULT_COLUMNS = (*ANNOTATION_COLUMNS, "llm_prediction", "llm_reason")

# `attempt_no` = run_no above this bit, seq below it: 17 trillion rows per run.
SEQ_BITS = 44
