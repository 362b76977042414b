"""Column functions on text."""

from functools import reduce

from pyspark.sql import Column, functions as F

from criteria_engine.fixed_values import DRUG_FILE_PATTERN, WHITESPACE
from criteria_engine.schemas import KEY


def strip(text) -> Column:
    """Drop Unicode white space from both ends, in one pass and without a regex."""
    return F.trim(text, F.lit(WHITESPACE))


def drug_name(source_file) -> Column:
    """Drug named by an annotation file; any other file name is returned as is."""
    source = F.col(source_file) if isinstance(source_file, str) else source_file
    name = F.regexp_extract(source, DRUG_FILE_PATTERN, 1)
    return F.when(name == "", source).otherwise(name)


def key_hash(key=KEY) -> Column:
    """SHA-256 of the key columns, each led by its length so that no two keys spell alike.

    Joins and groupings use these 32 bytes in place of whole sentences. A null
    in the key gives null, which equals no other key.
    """
    parts = [F.concat(F.length(k).cast("string"), F.lit(":"), F.col(k)) for k in key]
    return F.unhex(F.sha2(reduce(F.concat, parts).cast("binary"), 256))


def text_hash(text="criteria_text") -> Column:
    """SHA-256 of a text, by which it is stored; null for null."""
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))
