"""The registered queries, each over the whole of the driver's tables."""

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from criteria_engine.fixed_values import MODELS
from criteria_engine.functions import prompts, responses, text
from criteria_engine.operators import envelopes, keyed, lines, metrics, models, scoring
from criteria_engine.plans import driver_tables as tables
from criteria_engine.plans.classify import preview
from criteria_engine.plans.grading import grade
from criteria_engine.plans.publish import publish, published
from criteria_engine.plans.resume import run_models
from criteria_engine.schemas import ANNOTATION_COLUMNS
from criteria_engine.session import ship_package
from criteria_engine.sinks import exports
from criteria_engine.sinks.exports import PREDICTION_COLUMNS, predictions_export
from criteria_engine.sources.annotations import load_annotations
from criteria_engine.sources.attempts import read_attempts, read_results_csv
from criteria_engine.sources.segments import compact
from criteria_engine.sources.split_index import refresh
from criteria_engine.storage import names, shared_folder
from criteria_engine.streaming.resume import resume_stream

FIRST_ROWS = 100
PREVIEW_MODEL = "qwen"
RUN_CHUNK = 16
MERGE_BUCKET = 200
SELECTED = "gpt5, qwen,gpt5"
# A comparison in which one registered model has no results.
RUN_MODELS = MODELS[:3]


def _annotation_file(spark: SparkSession, sf_dir: str) -> str:
    """The derived lines as text files."""
    folder = shared_folder(spark)
    tables.lines(spark, sf_dir).select("line").write.text(folder)
    return folder


def _answered(spark, sf_dir, chosen=MODELS) -> DataFrame:
    return keyed.with_answers(tables.resp(spark, sf_dir, chosen))


def q_load_annotations(spark, sf_dir):
    loaded = load_annotations(spark, _annotation_file(spark, sf_dir))
    return loaded.select(*ANNOTATION_COLUMNS)


def q_drop_blank(spark, sf_dir):
    return lines.drop_blank(tables.lines(spark, sf_dir))


def q_drop_malformed(spark, sf_dir):
    return lines.split_fields(lines.drop_blank(tables.lines(spark, sf_dir)))


def q_valid_labels(spark, sf_dir):
    return lines.parse_lines(tables.lines(spark, sf_dir)).select("seq", "label")


def q_drug_name(spark, sf_dir):
    return tables.annotations(spark, sf_dir).select(
        "seq", "source_file", text.drug_name("source_file").alias("drug_name")
    )


def q_first_n(spark, sf_dir):
    loaded = lines.parse_lines(tables.lines(spark, sf_dir))
    return lines.first_n(loaded, FIRST_ROWS, ["seq"]).select(*ANNOTATION_COLUMNS)


def q_first_n_indexed(spark, sf_dir):
    """The first rows of several files in order, with an index that counts only their files."""
    folder = shared_folder(spark)
    ordered = tables.lines(spark, sf_dir).repartitionByRange("seq").sortWithinPartitions("seq")
    ordered.select("line").write.text(f"{folder}/in")
    return load_annotations(spark, f"{folder}/in", FIRST_ROWS, f"{folder}/index").select(*ANNOTATION_COLUMNS)


def q_split_counts(spark, sf_dir):
    """Lines and valid lines of all files, from the index; a second call reads no file."""
    folder = shared_folder(spark)
    tables.lines(spark, sf_dir).select("line").write.text(f"{folder}/in")
    refresh(spark, f"{folder}/in", f"{folder}/index")
    counted = refresh(spark, f"{folder}/in", f"{folder}/index")
    return counted.agg(F.sum("lines").alias("lines"), F.sum("valid").alias("valid"))


def q_section_route(spark, sf_dir):
    return tables.annotations(spark, sf_dir).select(
        "seq", "section", prompts.section_route().alias("route")
    )


def q_build_prompts(spark, sf_dir):
    return tables.rows(spark, sf_dir).select(
        "seq",
        prompts.system_prompt().alias("system_prompt"),
        prompts.user_prompt().alias("user_prompt"),
    )


def q_request_payload(spark, sf_dir):
    return models.fan_out(tables.rows(spark, sf_dir)).select(
        "seq", "model", prompts.request_payload().alias("payload")
    )


def q_decode_response(spark, sf_dir):
    return envelopes.decode_responses(tables.bodies(spark, sf_dir))


def q_parse_prediction(spark, sf_dir):
    return tables.resp(spark, sf_dir).select(
        "seq", "model", responses.parse_prediction().alias("prediction")
    )


def q_parse_reason(spark, sf_dir):
    return tables.resp(spark, sf_dir).select(
        "seq", "model", responses.parse_reason().alias("reason")
    )


def q_result_rows(spark, sf_dir):
    return keyed.result_rows(tables.resp(spark, sf_dir))


def q_valid_predictions(spark, sf_dir):
    return keyed.valid_predictions(_answered(spark, sf_dir)).select("seq", "model", "prediction")


def q_error_rows(spark, sf_dir):
    return keyed.error_rows(_answered(spark, sf_dir)).select("model", *ANNOTATION_COLUMNS)


def _first_run(spark, sf_dir) -> DataFrame:
    return tables.log(spark, sf_dir).where(F.col("run_no") == 1)


def q_prior_results(spark, sf_dir):
    stored = keyed.with_answers(tables.texts(spark, sf_dir, _first_run(spark, sf_dir)))
    return stored.select(
        "model", "run_no", "seq", "trial_id", "criteria_text", "prediction", "reason"
    )


def q_cached_rows(spark, sf_dir):
    wanted = models.fan_out(tables.staged(spark, sf_dir))
    return keyed.cached_rows(wanted, _first_run(spark, sf_dir)).select("seq", "model")


def q_pending_rows(spark, sf_dir):
    wanted = models.fan_out(tables.staged(spark, sf_dir))
    return keyed.pending_rows(wanted, _first_run(spark, sf_dir)).select("seq", "model")


def q_model_fanout(spark, sf_dir):
    return models.fan_out(tables.rows(spark, sf_dir)).select("seq", "ord", "model", "model_id")


def q_select_models(spark, sf_dir):
    chosen = models.select_models(SELECTED)
    return models.fan_out(tables.rows(spark, sf_dir), chosen).select("seq", "model", "model_id")


def _scored(spark, sf_dir, scorer, max_tries) -> DataFrame:
    ship_package(spark)
    wanted = models.fan_out(tables.rows(spark, sf_dir))
    return scoring.score(wanted, scorer, max_tries).select("seq", "model", "raw_response", "error")


def q_score_table(spark, sf_dir):
    return _scored(spark, sf_dir, tables.rule_scorer(), max_tries=1)


def q_score_errors(spark, sf_dir):
    scored = _scored(spark, sf_dir, scoring.row_scorer(_call_by_section), max_tries=3)
    return scored.where(responses.has_error())


def _call_by_section(model_id: str, system: str, user: str) -> str:
    """A call that fails in three ways, by model and section."""
    inclusion = '"INCLUSION CRITERIA" section' in user
    if model_id.startswith("mistralai/"):
        raise ValueError("bad request")
    if model_id.startswith("qwen/") and inclusion:
        raise scoring.RateLimited
    if model_id == "openai/gpt-5" and not inclusion:
        raise ConnectionError("connection reset")
    return "PREDICTION: 1\nREASON: listed"


def q_retry_failed(spark, sf_dir):
    return _scored(spark, sf_dir, tables.rule_scorer(), max_tries=3)


def q_union_attempts(spark, sf_dir):
    log = tables.log(spark, sf_dir)
    both = keyed.union_attempts(_first_run(spark, sf_dir), log.where(F.col("run_no") == 2))
    return both.select("model", "run_no", "seq", "raw_response", "error")


def q_current_results(spark, sf_dir):
    current = keyed.with_answers(keyed.current_results(tables.log(spark, sf_dir)))
    return current.select("model", "run_no", "seq", "trial_id", "prediction", "reason")


def q_calls_needed(spark, sf_dir):
    return keyed.calls_needed(tables.keyed_resp(spark, sf_dir)).select("model", "seq")


def q_resume_twice(spark, sf_dir):
    path = shared_folder(ship_package(spark))
    rows = tables.staged(spark, sf_dir)
    run_models(rows, path, tables.rule_scorer(), max_tries=1)
    run_models(rows, path, tables.rule_scorer(shift=4), max_tries=1)
    current = keyed.with_answers(keyed.current_results(read_attempts(spark, path, texts=False)))
    return current.select("model", "run_no", "seq", "label", "prediction", "reason")


def q_resume_compacted(spark, sf_dir):
    """Two runs on a log that is merged after each of them, in several buckets."""
    path = shared_folder(ship_package(spark))
    rows = tables.staged(spark, sf_dir)
    run_models(rows, path, tables.rule_scorer(), max_tries=1)
    compact(spark, path, runs=1, bucket_rows=MERGE_BUCKET)
    run_models(rows, path, tables.rule_scorer(shift=4), max_tries=1)
    compact(spark, path, runs=1, bucket_rows=MERGE_BUCKET)
    merged = keyed.with_answers(keyed.current_results(read_attempts(spark, path, texts=False)))
    return merged.select("model", "run_no", "seq", "label", "prediction", "reason")


def q_grades_by_run(spark, sf_dir):
    """Grades that are brought up to date after each of two runs."""
    path = shared_folder(ship_package(spark))
    rows = tables.staged(spark, sf_dir)
    for shift in (0, 4):
        run_models(rows, path, tables.rule_scorer(shift=shift), max_tries=1)
        graded = grade(spark, path)
    return graded


def q_confusion_matrix(spark, sf_dir):
    return metrics.confusion_matrix(_answered(spark, sf_dir))


def q_response_counts(spark, sf_dir):
    return metrics.response_counts(_answered(spark, sf_dir))


def q_classification_metrics(spark, sf_dir):
    return metrics.classification_metrics(_answered(spark, sf_dir))


def q_rounded_metrics(spark, sf_dir):
    graded = metrics.rounded_metrics(metrics.classification_metrics(_answered(spark, sf_dir)))
    return graded.select("model", *metrics.RATIOS)


def q_compare_models(spark, sf_dir):
    stored = keyed.current_results(tables.keyed_resp(spark, sf_dir, RUN_MODELS))
    return metrics.compare_models(keyed.with_answers(stored))


def q_compare_metrics(spark, sf_dir):
    return metrics.compare_metrics(_answered(spark, sf_dir))


def q_run_summary(spark, sf_dir):
    return keyed.run_summary(
        tables.staged(spark, sf_dir), tables.log(spark, sf_dir), run_no=2, models=MODELS
    )


def q_dry_run(spark, sf_dir):
    return keyed.dry_run_counts(tables.staged(spark, sf_dir), _first_run(spark, sf_dir), MODELS)


def q_dry_run_preview(spark, sf_dir):
    rows, stored = tables.staged(spark, sf_dir), _first_run(spark, sf_dir)
    return preview(rows, stored, models.select_models(PREVIEW_MODEL)).drop("model")


def q_predictions_export(spark, sf_dir):
    answered = _answered(spark, sf_dir)
    return predictions_export(answered).select(*PREDICTION_COLUMNS)


def q_parse_texts(spark, sf_dir):
    return tables.text_answers(spark, sf_dir).select(
        "seq", responses.parse_prediction().alias("prediction"), responses.parse_reason().alias("reason")
    )


def q_score_prompts(spark, sf_dir):
    return _scored(spark, sf_dir, scoring.row_scorer(tables.prompt_call), max_tries=1)


def q_run_counts(spark, sf_dir):
    """The summary of a run whose keys, the drugs, have many failures each."""
    path = shared_folder(ship_package(spark))
    rows = tables.staged(spark, sf_dir).withColumn("key_hash", text.key_hash(("drug_name",)))
    chosen = models.select_models(PREVIEW_MODEL)
    run_no = run_models(rows, path, tables.late_scorer, chosen, chunk_rows=RUN_CHUNK)
    return keyed.run_summary(rows, read_attempts(spark, path, texts=False), run_no, chosen)


def q_resume_stream(spark, sf_dir):
    """A stream over the files that the table's partitions make, half of them in a micro-batch."""
    folder = shared_folder(ship_package(spark))
    tables.lines(spark, sf_dir).select("line").write.text(f"{folder}/in")
    files = sum(name.startswith("part-") for name in names(spark, f"{folder}/in"))
    scorer = scoring.row_scorer(tables.accent_call)
    chosen = models.select_models(PREVIEW_MODEL)
    stream = resume_stream(
        spark, f"{folder}/in", f"{folder}/log", f"{folder}/checkpoint", scorer, chosen, files_per_batch=max(1, -(-files // 2))
    )
    stream.awaitTermination()
    current = keyed.with_answers(keyed.current_results(read_attempts(spark, f"{folder}/log")))
    return current.select("model", "trial_id", "criteria_text", "prediction")


def _csv(spark, path, columns) -> DataFrame:
    """An exported CSV; empty fields are empty texts or null numbers."""
    options = {"header": True, "multiLine": True, "escape": '"'}
    return spark.read.schema(columns).options(**options).csv(path).na.fill("")


def _each_model(read) -> DataFrame:
    parts = [read(name).withColumn("model", F.lit(name)) for name, _ in MODELS]
    return reduce(DataFrame.unionByName, parts)


_ANNOTATION = "drug_name string, label int, trial_id string, section string, criteria_text string"


def _exported(spark, current, write) -> str:
    folder = shared_folder(spark)
    for name, _ in MODELS:
        write(current, folder, name)
    return folder


def _current(spark, sf_dir, log) -> DataFrame:
    return tables.texts(spark, sf_dir, keyed.current_results(log))


def q_results_csv(spark, sf_dir):
    folder = _exported(spark, _current(spark, sf_dir, tables.log(spark, sf_dir)), exports.write_results)
    columns = f"{_ANNOTATION}, llm_prediction int, llm_reason string"
    return _each_model(lambda name: _csv(spark, f"{folder}/{name}", columns))


def q_error_csv(spark, sf_dir):
    folder = _exported(spark, _current(spark, sf_dir, tables.log(spark, sf_dir)), exports.write_error_rows)
    return _each_model(lambda name: _csv(spark, f"{folder}/error_output_{name}", _ANNOTATION))


def q_published_results(spark, sf_dir):
    """Result files of the second of two exports, as a reader finds them."""
    log, base = tables.log_folder(spark, sf_dir), shared_folder(spark)
    names = [name for name, _ in MODELS]
    for chosen in (names[:1], names):
        publish(spark, log, base, chosen)
    columns = f"{_ANNOTATION}, llm_prediction int, llm_reason string"
    return _each_model(lambda name: _csv(spark, f"{published(spark, base)}/{name}", columns))


def q_predictions_csv(spark, sf_dir):
    answered, folder = _answered(spark, sf_dir), shared_folder(spark)
    made = {name: exports.write_predictions(answered, folder, name, "run") for name, _ in MODELS}
    columns = (
        "drug_name string, trial_id string, section string, label int, prediction int, correct string, "
        "raw_response string, error string, criteria_text string"
    )
    return _each_model(lambda name: _csv(spark, f"{made[name]}/predictions", columns))


def q_metrics_json(spark, sf_dir):
    """Counts of the files; `q_rounded_metrics` has the ratios."""
    graded, folder = metrics.classification_metrics(_answered(spark, sf_dir)), shared_folder(spark)
    made = {name: exports.write_metrics(graded, folder, name, "run") for name, _ in MODELS}
    read = {name: spark.read.json(f"{path}/metrics") for name, path in made.items()}
    return _each_model(lambda name: read[name].select("confusion_matrix.*", "total", "valid", "errors"))


def q_comparison_json(spark, sf_dir):
    folder = shared_folder(spark)
    exports.write_comparison(metrics.classification_metrics(_answered(spark, sf_dir)), folder)
    found = spark.read.json(f"{folder}/comparison")
    each = lambda name: found.select(F.col(f"{name}.*")).select("confusion_matrix.*", "total", "valid", "errors")
    return _each_model(each)


def q_import_results(spark, sf_dir):
    """A first run's result files, taken over into a log."""
    folder = _exported(spark, _current(spark, sf_dir, _first_run(spark, sf_dir)), exports.write_results)
    taken = [read_results_csv(spark, f"{folder}/{name}", name) for name, _ in MODELS]
    current = keyed.current_results(reduce(DataFrame.unionByName, taken))
    return keyed.with_answers(current).select("model", "trial_id", "criteria_text", "prediction", "reason")


QUERIES = {name: query for name, query in list(globals().items()) if name.startswith("q_")}
