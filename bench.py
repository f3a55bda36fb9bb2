"""Times the headline queries and prints one JSON line.

The tables are first written anew, row for row, as eight files each: the given files have one row
group, which Spark cannot split, where a large table has many. This is not timed.

``BENCH_SF_DIR`` names the data, ``BENCH_CPUS`` the cores. Each query runs whole, with its result
written to Spark's no-op sink; the time is the faster of two runs, so that code generation and
JVM warm-up of the first do not count.
"""

from __future__ import annotations

import glob
import json
import os
import tempfile
import time

from respeval.plans.catalog import QUERIES
from respeval.plans.relations import responses
from respeval.session import local_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "score_responses",
    "text_features",
    "unique_word_ratio",
    "detect_defects",
    "judge_score",
    "row_cost",
    "cost_by_model",
    "cumulative_cost",
    "budget_alerts",
    "request_rate",
    "report_statistics",
    "executive_summary",
    "dimension_averages",
    "defect_summary",
    "run_summary",
    "overall_histogram",
    "lint_prompts",
    "validate_scored",
    "duplicate_ids",
    "clean_results",
    "quality_report_table",
    "quality_report_columns",
    "regression_report",
    "execute_prompts",
    "map_chunks",
    "sanitize_string",
    "stream_score",
    "stream_request_rate",
    "stream_budget_alerts",
]


def as_many_files(spark) -> str:
    folder = tempfile.mkdtemp(prefix="bench-")
    for path in glob.glob(f"{SF_DIR}/*.parquet"):
        spark.read.parquet(path).repartition(8).write.parquet(f"{folder}/{os.path.basename(path)}")
    return folder


def run(spark, name: str, folder: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = local_session("bench", CPUS)
    folder = as_many_files(spark)
    times = {name: round(min(run(spark, name, folder) for _ in range(2)), 3) for name in HEADLINE}
    n = responses(spark, folder).filter("status = 'success'").count()
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
                "responses_scored": n,
                "responses_per_second": round(n / times["score_responses"], 1),
            }
        )
    )


if __name__ == "__main__":
    main()
