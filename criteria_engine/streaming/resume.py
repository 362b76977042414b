"""The resumable run as a stream over arriving annotation files."""

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from criteria_engine.fixed_values import MODELS
from criteria_engine.operators.lines import parse_lines
from criteria_engine.operators.scoring import Scorer
from criteria_engine.plans.resume import run_models
from criteria_engine.sources.annotations import stage_annotations
from criteria_engine.sources.segments import last_run
from criteria_engine.storage import discard, names, read_record, write_record


def read_line_stream(spark: SparkSession, path: str, files_per_batch: int | None = None):
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path).select(
        F.col("_metadata.file_path").alias("src_file"),
        F.col("_metadata.file_block_start").alias("src_block"),
        F.col("value").alias("line"),
    )


def resume_stream(
    spark: SparkSession,
    path: str,
    log_path: str,
    checkpoint: str,
    scorer: Scorer,
    models=MODELS,
    *,
    files_per_batch: int | None = None,
    **options,
) -> StreamingQuery:
    """Answer the files that arrived since the last start, then stop.

    Every micro-batch is one run on the log. Its run number is recorded under the stream's id
    and the batch's before anything is asked, and that it is over is recorded after. A batch
    that is repeated after a crash finds its record: it goes on under its number, keeps the
    answers in the log and asks for the rest, or does nothing if it was over. What a batch
    stores beside the log lies next to its record and goes with it.
    """

    def step(batch: DataFrame, batch_id: int) -> None:
        stream = read_record(spark, f"{checkpoint}/metadata")["id"]
        answer_batch(batch, batch_id, f"{log_path}/streams/{stream}", log_path, scorer, models, **options)

    return (
        read_line_stream(spark, path, files_per_batch)
        .writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def answer_batch(lines: DataFrame, batch_id: int, records: str, log_path: str, scorer: Scorer, models=MODELS, **options) -> int:
    """One micro-batch, as often as it is repeated, as one run; returns its number."""
    spark = lines.sparkSession
    staging = f"{records}/staging"
    begun, over = _records(spark, records, batch_id, "begun"), _records(spark, records, batch_id, "over")
    if over:
        discard(spark, staging)
        return over[-1]
    last = last_run(spark, log_path)
    # a run that others came after is closed; its answers count like those of any earlier run
    run_no = begun[-1] if begun and begun[-1] >= last else last + 1
    if run_no not in begun:
        write_record(spark, f"{records}/{batch_id}-{run_no}.begun", {})
    numbered = lines.withColumn("src_row", F.monotonically_increasing_id())
    rows = stage_annotations(parse_lines(numbered), f"{staging}/annotations")
    run_models(rows, log_path, scorer, models, run_no=run_no, folder=f"{staging}/run", **options)
    write_record(spark, f"{records}/{batch_id}-{run_no}.over", {})
    discard(spark, staging)
    for name in names(spark, records):
        # only the last batch can be repeated
        if name[:1].isdigit() and int(name.split("-")[0]) < batch_id:
            discard(spark, f"{records}/{name}")
    return run_no


def _records(spark: SparkSession, folder: str, batch_id: int, kind: str) -> list[int]:
    """Run numbers that a batch has records of."""
    found = [name.removesuffix(f".{kind}") for name in names(spark, folder) if name.endswith(f".{kind}")]
    return sorted(int(run) for batch, run in (name.split("-") for name in found) if int(batch) == batch_id)
