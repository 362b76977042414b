"""Decode chat-completion response bodies."""

from pyspark.sql import DataFrame, functions as F

from criteria_engine.functions.text import strip

NOT_JSON = "response is not JSON"
MALFORMED = "malformed response"

# Places in a body that decide how it is read.
_PATHS = {
    "root": "$",
    "choices": "$.choices",
    "choice": "$.choices[0]",
    "failure": "$.choices[0].error",
    "failure_text": "$.choices[0].error.message",
    "message": "$.choices[0].message",
    "content": "$.choices[0].message.content",
}


def decode_responses(bodies: DataFrame, body: str = "body") -> DataFrame:
    """Replace a response body by `raw_response`, `error` and `retryable`.

    An error inside the first choice wins over its message. A missing choice list
    or message is an empty answer; a body of any other shape is an error row; a
    body that is not JSON may be retried. Each body is parsed once, as a variant.
    """
    others = bodies.drop(body).columns
    # separate projections, so that the parse is not repeated per path
    parsed = bodies.withColumn("_doc", F.try_parse_json(body))
    found = parsed.select(
        *others,
        F.col("_doc").isNull().alias("retryable"),
        F.struct(
            *[F.try_variant_get("_doc", path, "variant").alias(n) for n, path in _PATHS.items()]
        ).alias("_at"),
    )

    def at(name):
        return F.col(f"_at.{name}")

    def text(name):
        return at(name).cast("string")

    def is_a(name, kind):
        return F.coalesce(F.schema_of_variant(at(name)).startswith(kind), F.lit(False))

    # an error that is absent, null, false, zero or empty is none
    failed = (
        at("failure").isNotNull()
        & ~F.is_variant_null(at("failure"))
        & ~text("failure").isin("", "false", "0", "{}", "[]")
    )
    missing = (
        at("choices").isNull()
        | at("message").isNull() & is_a("choice", "OBJECT")
        | at("content").isNull() & is_a("message", "OBJECT")
    )
    answered = ~failed & is_a("content", "STRING")
    # good bodies first: only the others are looked at further
    error = (
        F.when(answered, None)
        .when(F.col("retryable"), NOT_JSON)
        .when(~is_a("root", "OBJECT"), MALFORMED)
        .when(failed & ~is_a("failure", "OBJECT"), MALFORMED)
        .when(failed & at("failure_text").isNull(), text("failure"))
        .when(failed, text("failure_text"))
        .when(~missing, MALFORMED)
    )
    return found.select(
        *others,
        F.when(answered, strip(text("content"))).otherwise("").alias("raw_response"),
        error.alias("error"),
        "retryable",
    )
