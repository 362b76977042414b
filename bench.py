"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path
from tempfile import TemporaryDirectory

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from criteria_engine.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "q_load_annotations",
    "q_prior_results",
    "q_build_prompts",
    "q_request_payload",
    "q_decode_response",
    "q_result_rows",
    "q_score_table",
    "q_retry_failed",
    "q_pending_rows",
    "q_current_results",
    "q_calls_needed",
    "q_resume_twice",
    "q_resume_compacted",
    "q_grades_by_run",
    "q_classification_metrics",
    "q_compare_models",
    "q_run_summary",
    "q_run_counts",
    "q_import_results",
    "q_dry_run",
]


def main() -> None:
    with TemporaryDirectory(prefix="criteria_engine_") as folder:
        bench(folder)


def bench(folder: str) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("criteria_engine_bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", folder)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE

    def run(name, folder=sf_dir):
        # every row and column is computed, none is sent to the driver
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()

    # start-up, not measured: each query once on the smallest tables, if there are any
    small = Path(sf_dir).resolve().parent / "sf0.001"
    for name in names if small.exists() else []:
        run(name, str(small))
    seconds = {}
    for name in names:
        start = time.perf_counter()
        run(name)
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
