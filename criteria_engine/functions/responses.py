"""Column functions that read model answers."""

from pyspark.sql import Column, functions as F

from criteria_engine.fixed_values import WHITESPACE_CLASS
from criteria_engine.functions.text import strip

def _or_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def _labelled(text) -> Column:
    return _or_null(F.regexp_extract(text, rf"(?iu)PREDICTION:{WHITESPACE_CLASS}*([01])", 1))


def has_error(error="error") -> Column:
    """An empty error text counts as no error."""
    return F.coalesce(F.col(error) != "", F.lit(False))


def parse_prediction(text="raw_response") -> Column:
    """The 0 or 1 after `PREDICTION:`, else the first 0 or 1 anywhere, else null."""
    return F.coalesce(_labelled(text), _or_null(F.regexp_extract(text, "[01]", 0))).cast("int")


def parse_reason(text="raw_response") -> Column:
    """First line after `REASON:`; the whole text if that and the labelled prediction are missing."""
    tail = F.regexp_extract(text, rf"(?isu)REASON:{WHITESPACE_CLASS}*(.+)", 1)
    reason = strip(F.split_part(strip(tail), F.lit("\n"), F.lit(1)))
    return F.when(_labelled(text).isNull() & (reason == ""), strip(text)).otherwise(reason)


def prediction(text="raw_response", error="error") -> Column:
    """Stored prediction: null for a failed request."""
    return F.when(~has_error(error), parse_prediction(text))


def reason(text="raw_response", error="error") -> Column:
    """Stored reason: `ERROR: <message>` for a failed request."""
    return F.when(has_error(error), F.concat(F.lit("ERROR: "), F.col(error))).otherwise(
        parse_reason(text)
    )


def is_valid(predicted) -> Column:
    """True for 0 and 1, false for anything else, null included."""
    return F.coalesce(F.col(predicted).isin(0, 1), F.lit(False))


def answer_is_valid(text="raw_response", error="error") -> Column:
    """Whether an answer parses to a prediction: no error, and a 0 or 1 in the text."""
    return ~has_error(error) & F.coalesce(F.col(text).rlike("[01]"), F.lit(False))


def correct(label="label", predicted="prediction") -> Column:
    """Null where there is no prediction."""
    return F.col(label) == F.col(predicted)
