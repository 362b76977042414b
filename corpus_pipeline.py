"""A cleaning pipeline over `documents`, from raw texts to packed sequences."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from criteria_engine.llm import bagminhash, decontaminate, line_dedup, packing, toxicity
from criteria_engine.llm.tables import prepare, scratch, stored, table


COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with the columns that no stage knows in one, under a free name, and the way back.

    So no column of the user's meets one that an operator adds.
    """
    known, others = ([c for c in docs.columns if (c in COLUMNS) == k] for k in (True, False))
    name = "others"
    while name in docs.columns:
        name += "_"
    fields = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]
    held = docs.select(*known, *([F.struct(*fields).alias(name)] if others else []))
    place = {c: F.col(name)[f"c{i}"].alias(c) for i, c in enumerate(others)}
    return held, lambda out: out.select(*[place[c] if c in place else F.col(c) for c in docs.columns])


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects, by the threshold of their language, go."""
    model = toxicity.fit(docs.select("doc_id", "text", "lang"), table(prepare(spark), sf_dir, "labels"))
    held, whole = _apart(docs)
    rest = [c for c in held.columns if c not in ("doc_id", "text", "lang")]
    scored = toxicity.score(held, model, keep=tuple(rest)).where(~F.col("rejected"))
    return whole(scored.select(*[F.col(f"kept_{c}").alias(c) if c in rest else F.col(c) for c in held.columns]))


def without_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has too go; so do documents of which nothing is left."""
    prepare(spark)
    held, whole = _apart(docs)
    found = line_dedup.dedup_lines(held)
    left = found.where((F.col("n_removed") == 0) | (F.trim("text") != ""))
    n_chars = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")
    return whole(left.withColumn("n_chars", n_chars).select(*held.columns))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays."""
    prepare(spark)
    found = bagminhash.near_duplicates(docs.select("doc_id", "text"))
    others = found.where("doc_id <> class_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, within the edit budget, go."""
    held, whole = _apart(docs)
    found = decontaminate.find_items(held, table(prepare(spark), sf_dir, "benchmark"))
    return whole(found.where(F.size("matches") == 0).select(*held.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens, each a sequence of its own."""
    prepare(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", without_toxic),
    ("line_dedup", without_shared_lines),
    ("near_duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), folder)
    return STAGES[-1][1](spark, docs, sf_dir)


# Classifier, signatures, alignment and tokenizer are beyond SQL; tests compare the stages.
ORACLE_SQL = None
