"""Whole runs: evaluate, score, report, check for regressions."""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respeval.functions.scores import DEFAULT_WEIGHTS
from respeval.operators import baselines, reports
from respeval.operators.costs import cost_by_model, cost_summary, row_cost
from respeval.operators.execute import (
    error_stats,
    failed_requests,
    filter_success,
)
from respeval.operators.regression import regression_report, run_verdict
from respeval.operators.scoring import Rubric, score_responses
from respeval.sources.prompts import load_prompts
from respeval.sources.results import load_baseline, save_as_baseline, save_report
from respeval.sources.storage import remove, write_and_read
from respeval.streaming.answers import execute_resumable


def score_results(results: DataFrame, rubric: Rubric | None = None) -> DataFrame:
    """Successful rows with scores, defects and cost. One projection, no shuffle."""
    return row_cost(score_responses(filter_success(results), rubric))


def track_execution(results: DataFrame, budget_limit: float | None = None) -> dict[str, DataFrame]:
    """What became of an executed batch: its summary, cost and failures as tables."""
    failed = failed_requests(results)
    usage = row_cost(filter_success(results))
    return {
        "summary": reports.execution_summary(results),
        "costs": cost_summary(usage, budget_limit),
        "cost_by_model": cost_by_model(usage),
        "failed": failed,
        "errors": error_stats(failed),
    }


REPORTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "statistics": reports.report_statistics,
    "executive_summary": reports.executive_summary,
    "dimension_averages": reports.dimension_averages,
    "accuracy_histogram": reports.accuracy_histogram,
    "overall_histogram": reports.overall_histogram,
    "defect_summary": reports.defect_summary,
}


def _report_columns(scored: DataFrame) -> DataFrame:
    """The columns that reports read: scores and defects, no texts; of a table without scores the first as well."""
    read = {*DEFAULT_WEIGHTS, "aggregated_score", "overall_score", "defects"}
    names = [c for c in scored.columns if c.lower() in read or c.lower().startswith("score_")]
    if not {"aggregated_score", "overall_score"} & set(names) and scored.columns[0] not in names:
        names.insert(0, scored.columns[0])
    return scored.select(*[F.col(f"`{c}`") for c in names])


def write_reports(scored: DataFrame, path: str) -> dict[str, str]:
    """Write the report tables of a scored table; returns name -> path of those that worked.

    The columns that reports read are stored first, so that a table that is scored as it is read is scored once. A
    report that fails, for example for want of its column, does not stop the others; nor does a column that
    cannot be stored, without which each report reads the given table.
    """
    try:
        scored = write_and_read(_report_columns(scored), "scored")
    except (PySparkException, ValueError, IndexError) as e:
        warnings.warn(f"scores are not stored: {e}", stacklevel=2)
    written = {}
    for name, build in REPORTS.items():
        try:
            save_report(build(scored), f"{path}/{name}", "json")
        except (PySparkException, ValueError, IndexError) as e:
            warnings.warn(f"report {name} failed: {e}", stacklevel=2)
        else:
            written[name] = f"{path}/{name}"
    return written


def evaluate(
    spark: SparkSession,
    prompt_path: str,
    fn: Callable[[str], str],
    output: str,
    rubric: Rubric | None = None,
    model: str = "gpt-4",
    concurrency: int | None = None,
) -> DataFrame:
    """Prompts from files through ``fn`` to stored raw results, scored results and reports.

    Answers are logged batch by batch under ``output/calls`` until the raw results are stored. A run
    that was lost goes on from there when it is called again, and asks only what has no answer yet;
    each different prompt is asked once.
    """
    prompts = load_prompts(spark, prompt_path)
    raw = execute_resumable(prompts, fn, f"{output}/calls", model, concurrency)
    raw.write.mode("overwrite").parquet(f"{output}/raw")
    remove(spark, f"{output}/calls")
    scored = score_results(spark.read.parquet(f"{output}/raw"), rubric)
    scored.write.mode("overwrite").parquet(f"{output}/scored")
    stored = spark.read.parquet(f"{output}/scored")
    write_reports(stored, f"{output}/reports")
    return stored


def check_run(
    spark: SparkSession, current: DataFrame, baseline_path: str, update_baseline: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Regression report and verdict of a run against the stored baseline.

    ``update_baseline`` stores the run as the new baseline; the report is computed first.
    """
    report = regression_report(load_baseline(spark, baseline_path), current)
    report = spark.createDataFrame(report.collect(), report.schema)  # a row per metric
    if update_baseline:
        save_as_baseline(current, baseline_path)
    return report, run_verdict(report)


def check_against_baselines(spark: SparkSession, current: DataFrame, path: str, keep_as: str | None = None) -> DataFrame:
    """Regression report of a run against every baseline whose statistics are kept under ``path``.

    The run is read once, the baselines' rows not at all. ``keep_as`` keeps the run's statistics as one more baseline, after
    the report is made.
    """
    own = baselines.run_statistics(current)
    own = spark.createDataFrame(own.collect(), baselines.STATISTICS_SCHEMA)  # a row per metric
    kept = baselines.load_statistics(spark, path)
    if kept is None:
        kept = spark.createDataFrame([], f"baseline string, {baselines.STATISTICS_SCHEMA}")
    report = baselines.compare_statistics(kept, own, ["baseline"])
    report = spark.createDataFrame(report.collect(), report.schema)  # a row per baseline and metric
    if keep_as is not None:
        own.coalesce(1).write.mode("overwrite").parquet(f"{path}/baseline={keep_as}")
    return report
