"""From raw annotation lines to typed annotations."""

from pyspark.sql import Column, DataFrame, functions as F

from criteria_engine.functions.text import drug_name, strip

FIELDS = ("source_file", "raw_label", "trial_id", "section", "criteria_text")


def drop_blank(lines: DataFrame, line: str = "line") -> DataFrame:
    """Strip each whole line, outer tabs included, and drop the empty ones."""
    return lines.withColumn(line, strip(line)).where(F.col(line) != "")


def split_fields(lines: DataFrame, line: str = "line") -> DataFrame:
    """Replace a stripped line by its first five tab fields; drop lines with fewer."""
    others = [c for c in lines.columns if c != line]
    # Limit 6: whatever follows the fifth field stays in one piece and is dropped.
    # Filters are not pushed through explode, so each line is stripped and split once.
    split = F.explode(F.array(F.split(line, "\t", 6))).alias("_fields")
    return lines.select(*others, split).where(F.size("_fields") >= 5).select(
        *others, *[F.col("_fields")[i].alias(name) for i, name in enumerate(FIELDS)]
    )


def type_fields(fields: DataFrame) -> DataFrame:
    """Keep labels 0 and 1, derive the drug name, strip the rest."""
    others = [c for c in fields.columns if c not in FIELDS]
    label = strip("raw_label")
    return fields.where(label.isin("0", "1")).select(
        *others,
        drug_name("source_file").alias("drug_name"),
        label.cast("int").alias("label"),
        *[strip(c).alias(c) for c in ("trial_id", "section", "criteria_text")],
    )


def is_valid(line: str = "line") -> Column:
    """Whether `parse_lines` keeps a line."""
    fields = F.split(strip(line), "\t", 6)
    return (F.size(fields) >= 5) & F.coalesce(strip(F.get(fields, 1)).isin("0", "1"), F.lit(False))


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Typed annotations of the valid lines; other columns are carried along."""
    # a blank line has one field, so it goes with the short ones
    return type_fields(split_fields(lines.withColumn(line, strip(line)), line))


def first_n(rows: DataFrame, n: int | None, order) -> DataFrame:
    """First `n` rows by `order`, None for all; each task keeps `n` rows at most."""
    if n is None:
        return rows
    if n < 0:
        raise ValueError(f"number of rows must not be negative: {n}")
    return rows.orderBy(*order).limit(n)
