"""Sentences of the attempts log, each stored once under its digest.

    fresh/<id>/, fresh/<id>.json     additions, each with texts that were not stored before it
    texts/<id>/bucket=B/             additions that a merge of the log joined

An addition counts once its record is there, and until a manifest names it as absorbed. So every
digest stands in one place whatever breaks off, and attempts find their texts by a plain join.
Texts of merged additions lie in buckets by the first bits of the digest; an addition
looks for known texts in the buckets of its own digests. One writer per log.
"""

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from criteria_engine.operators.bloom import likely_in
from criteria_engine.schemas import ATTEMPTS, TEXTS
from criteria_engine.sources.manifests import manifest, prefixes, read_buckets, write_buckets
from criteria_engine.storage import discard, names, read_record, shared_folder, store, write_record


def additions(spark: SparkSession, path: str, state: dict) -> dict[str, int]:
    """Rows of the additions that count and are not in the manifest's texts."""
    found = [name.removesuffix(".json") for name in names(spark, f"{path}/fresh") if name.endswith(".json")]
    loose = [name for name in found if name not in state["absorbed"]]
    return {name: read_record(spark, f"{path}/fresh/{name}.json")["rows"] for name in loose}


def _merged(spark: SparkSession, path: str, part: dict, wanted: set[int] | None = None) -> DataFrame:
    return read_buckets(spark, f"{path}/texts/{part['name']}", TEXTS, part["bits"], wanted).select(*TEXTS.names)


def _fresh(spark: SparkSession, path: str, added: list[str]) -> list[DataFrame]:
    return [spark.read.schema(TEXTS).parquet(*[f"{path}/fresh/{name}" for name in added])] if added else []


def read_texts(spark: SparkSession, path: str, near: DataFrame | None = None) -> DataFrame | None:
    """Digest and text, each digest once; None without any.

    With `near`, buckets without digests of its rows are not read.
    """
    state, wanted = manifest(spark, path), None
    if near is not None and any(part["bits"] for part in state["texts"]):
        wanted = prefixes(near, "text_hash")
    parts = [_merged(spark, path, part, wanted) for part in state["texts"]]
    parts += _fresh(spark, path, list(additions(spark, path, state)))
    return reduce(DataFrame.unionByName, parts) if parts else None


def with_texts(spark: SparkSession, path: str, logged: DataFrame) -> DataFrame:
    """Stored attempts (LOGGED) with their sentences, as ATTEMPTS.

    Both sides are plain tables below their shuffles, so a sentence that a third of the
    attempts share is split. Take current results first: then only their rows move.
    """
    texts = read_texts(spark, path)
    if texts is None:
        found = logged.withColumn("criteria_text", F.lit(None).cast("string"))
    else:
        found = logged.join(texts, "text_hash", "left")
    return found.select(*ATTEMPTS.names)


def add_texts(rows: DataFrame, path: str, number: str = "seq", asked: DataFrame | None = None) -> int:
    """Store the sentences of `rows` that are not stored yet; returns how many.

    `rows` have `text_hash`, `criteria_text` and a `number`; rows that agree on it have one
    text. They are read for digests first, and again for the texts only if some are new. With
    `asked`, which needs no texts, its `number` and `text_hash` say which of the rows' sentences
    are meant. Texts move once, and of rows that share one hardly more than one.
    """
    spark, folder = rows.sparkSession, shared_folder(rows.sparkSession)
    try:
        asked = rows if asked is None else asked
        first = asked.where(F.col("text_hash").isNotNull()).groupBy("text_hash").agg(F.min(number).alias(number))
        first, found = store(first, f"{folder}/digests")
        known = read_texts(spark, path, first) if found["n"] else None
        if known is not None:
            first, found = store(first.join(known.select("text_hash"), "text_hash", "left_anti"), f"{folder}/new")
        if not found["n"]:
            return 0
        # about one row of each text gets past the filter
        near = likely_in(rows, first, number, found["n"])
        # each digest has one number: grouped by both, the texts stay where the join left them
        texts = near.join(first, ["text_hash", number]).groupBy("text_hash", number).agg(F.first("criteria_text").alias("criteria_text"))
        texts = texts.drop(number)
        name = uuid4().hex
        _, written = store(texts, f"{path}/fresh/{name}")
        write_record(spark, f"{path}/fresh/{name}.json", {"rows": written["n"]})
        return written["n"]
    finally:
        discard(spark, folder)


def merge_texts(spark: SparkSession, path: str, state: dict, growth: int, bucket_rows: int) -> dict:
    """Join the additions, and merged texts that are not much larger, into one folder.

    Returns `texts` and `absorbed` of the next manifest; until it is written nothing has changed.
    """
    loose, kept = additions(spark, path, state), list(state["texts"])
    gone = sorted({name.split(".")[0] for name in names(spark, f"{path}/fresh")})
    rows = sum(loose.values())
    if not rows:
        return {"texts": kept, "absorbed": gone}
    parts = _fresh(spark, path, list(loose))
    while kept and kept[-1]["rows"] <= growth * rows:
        rows += kept[-1]["rows"]
        parts.append(_merged(spark, path, kept.pop()))
    name = uuid4().hex
    bits = write_buckets(reduce(DataFrame.unionByName, parts), f"{path}/texts/{name}", "text_hash", rows, bucket_rows)
    return {"texts": [*kept, {"name": name, "rows": rows, "bits": bits}], "absorbed": gone}


def sweep_texts(spark: SparkSession, path: str, before: dict, now: dict) -> None:
    """Remove what the last two manifests do not need."""
    named = {part["name"] for state in (before, now) for part in state["texts"]}
    for name in names(spark, f"{path}/texts"):
        if name not in named:
            discard(spark, f"{path}/texts/{name}")
    for name in before["absorbed"]:
        discard(spark, f"{path}/fresh/{name}.json")
        discard(spark, f"{path}/fresh/{name}")
