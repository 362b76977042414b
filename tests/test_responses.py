import json
import random
import re

import pytest
from pyspark.sql import functions as F

from criteria_engine.fixed_values import WHITESPACE
from criteria_engine.functions import responses
from criteria_engine.functions.text import key_hash, strip
from criteria_engine.operators.envelopes import MALFORMED, NOT_JSON, decode_responses

TEXTS = [
    ("PREDICTION: 1\nREASON: a", 1, "a"),
    ("prediction: 10", 1, ""),
    ("PREDICTION:\xa00", 0, ""),
    ("**PREDICTION:** 1\nREASON: a\nb", 1, "a"),
    ("PREDICTION: unknown\nREASON: Phase 1 trial", 1, "Phase 1 trial"),
    ("REASON:\n\n foo \r\nbar", None, "foo"),
    ("I think the answer is 1.", 1, "I think the answer is 1."),
    ("none", None, "none"),
    ("", None, ""),
    ("PREDICTION: x PREDICTION: 0", 0, ""),
    ("REASON:   ", None, "REASON:"),
    ("PREDİCTİON: 1 0", 1, ""),
    (" two\nlines 0 ", 0, "two\nlines 0"),
]


def expected(text):
    """The parsing rules on one answer."""
    label = re.compile(r"prediction:\s*([01])", re.I).search(text)
    digits = [c for c in text if c in "01"]
    found = label.group(1) if label else digits[0] if digits else None
    after = re.compile(r"reason:\s*(.+)", re.I | re.S).search(text)
    reason = after.group(1).strip().partition("\n")[0].strip() if after else ""
    if not label and not reason:
        reason = text.strip()
    return None if found is None else int(found), reason


def parsed(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "raw_response string")
    rows = df.select(responses.parse_prediction(), responses.parse_reason()).collect()
    return [tuple(r) for r in rows]


def test_answer_texts(spark):
    assert parsed(spark, [t for t, _, _ in TEXTS]) == [(p, r) for _, p, r in TEXTS]


def test_random_answers(spark):
    rng = random.Random(3)
    pieces = ["PREDICTION:", "prediction:", "REASON:", "Reason:", "0", "1", "2", "word", "\n", "*"]
    pieces += [*WHITESPACE, "İ", "ſ", "reaſon:", "é"]
    texts = ["".join(rng.choices(pieces, k=rng.randrange(9))) for _ in range(10_000)]
    assert parsed(spark, texts) == [expected(t) for t in texts]


def test_strip_is_unicode_aware(spark):
    texts = [c + "a" + c + "b" + c for c in map(chr, range(1, 0x3100))] + ["", WHITESPACE]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(strip("t")).collect()] == [t.strip() for t in texts]


def test_failed_requests(spark):
    rows = [("PREDICTION: 1", "down"), ("PREDICTION: 1", ""), ("PREDICTION: 1\nREASON: r", None)]
    df = spark.createDataFrame(rows, "raw_response string, error string")
    got = df.select(
        responses.prediction(), responses.reason(), responses.answer_is_valid()
    ).collect()
    assert [tuple(r) for r in got] == [(None, "ERROR: down", False), (1, "", True), (1, "r", True)]


def test_valid_without_parsing(spark):
    """An answer has a prediction exactly when it holds a 0 or 1."""
    texts = [t for t, _, _ in TEXTS]
    df = spark.createDataFrame([(t, None) for t in texts], "raw_response string, error string")
    for row in df.select(responses.prediction().alias("p"), responses.answer_is_valid()).collect():
        assert (row.p is not None) == row[1]


def test_validity_counts_null_and_other_values_as_errors(spark):
    df = spark.createDataFrame([(0,), (1,), (2,), (None,)], "prediction int")
    assert [r[0] for r in df.select(responses.is_valid("prediction")).collect()] == [
        True,
        True,
        False,
        False,
    ]


def choice(**fields):
    return json.dumps({"choices": [fields]})


BODIES = [
    (choice(message={"content": " PREDICTION: 1\n"}), "PREDICTION: 1", None),
    (choice(message={"content": "a"}, error=None), "a", None),
    (choice(message={"content": "a"}, error={}), "a", None),
    (choice(message={"content": "a"}, error={"message": "m"}), "", "m"),
    (choice(error={"message": ""}), "", ""),
    (choice(error={"message": None}), "", None),
    (choice(error={"code": 5}), "", '{"code":5}'),
    (choice(error="boom"), "", MALFORMED),
    (choice(message={}), "", None),
    (choice(message=None), "", MALFORMED),
    (choice(message={"content": None}), "", MALFORMED),
    (choice(message={"content": ["a"]}), "", MALFORMED),
    (choice(), "", None),
    ("{}", "", None),
    ('{"choices": []}', "", MALFORMED),
    ('{"choices": null}', "", MALFORMED),
    ('{"choices": {"a": 1}}', "", MALFORMED),
    ('{"choices": ["a"]}', "", MALFORMED),
    ("[1]", "", MALFORMED),
    ("gateway timeout", "", NOT_JSON),
    ("", "", NOT_JSON),
]


def test_response_bodies(spark):
    df = spark.createDataFrame(
        [(i, body) for i, (body, _, _) in enumerate(BODIES)], "i int, body string"
    )
    got = decode_responses(df).orderBy("i").collect()
    assert [(r.raw_response, r.error) for r in got] == [(a, e) for _, a, e in BODIES]
    assert [r.retryable for r in got] == [e == NOT_JSON for _, _, e in BODIES]


def test_body_is_parsed_once(spark):
    df = spark.createDataFrame([("{}",)], "body string")
    plan = decode_responses(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("try_parse_json(") + plan.count("parseJson") <= 1


def test_keys_differ_where_their_parts_do(spark):
    rows = [("a", "bc"), ("ab", "c"), ("", "abc"), ("abc", ""), ("1:a", ""), ("", "1:a")]
    df = spark.createDataFrame(rows + rows, "trial_id string, criteria_text string")
    assert df.select(key_hash().alias("k")).distinct().count() == len(rows)
    with_drug = df.withColumn("drug_name", F.lit("d")).select(
        key_hash(("trial_id", "criteria_text", "drug_name")).alias("k")
    )
    assert with_drug.distinct().count() == len(rows)


@pytest.mark.parametrize("size", [100_000])
def test_long_texts(spark, size):
    text = "x" * size + " " * size + "PREDICTION: 0\nREASON: " + "y" * size
    assert parsed(spark, [text]) == [(0, "y" * size)]
