"""What the physical plans must and must not hold."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from respeval.operators.quality import clean_results, duplicate_ids, validate_table
from respeval.operators.prompts import lint_prompts
from respeval.operators.regression import metric_tests, regression_report
from respeval.operators.reports import defect_summary, overall_histogram, report_statistics
from respeval.operators.running import running_sum
from respeval.operators.scoring import score_responses
from respeval.plans.workflows import score_results


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def stored(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr(
        "cast(id as string) AS prompt_id", "repeat('because so ', 5) AS response",
        "'gpt-4' AS model", "'success' AS status", "'p' AS prompt", "id AS unused",
        "cast(id % 5 as double) AS overall_score", "cast(id % 5 as double) AS score_tone",
        "'A' AS grade",
    ).write.parquet(path)
    return spark.read.parquet(path)


def test_scoring_is_narrow_and_in_the_jvm(stored):
    text = plan(score_results(stored.drop("overall_score", "score_tone")))
    assert "Exchange" not in text and "Python" not in text
    # Every operator on the rows is inside whole-stage code generation.
    operators = re.findall(r"^[ +-]*(.*?)(?:Project|Generate|Filter) [\[(i]", text, re.MULTILINE)
    assert operators and all(o.startswith("*(") for o in operators), text
    assert "PushedFilters: [IsNotNull(status), EqualTo(status,success)]" in text


def test_only_needed_columns_are_read(stored):
    text = plan(score_responses(stored.select("response", "unused", "model")).select("accuracy"))
    assert "ReadSchema: struct<response:string>" in text


def test_filter_on_a_score_copies_no_regex(stored):
    """Each text feature is computed in one place, also under a filter on the score."""
    base = stored.select("prompt_id", "response")
    text = plan(score_responses(base).filter("overall_score < 3 and tone > 1"))
    assert text.count("s(?:ince") == 1
    assert text.count("Generate inline") == 1


def test_reports_shuffle_one_row_per_task(stored):
    text = plan(report_statistics(stored))
    assert text.count("Exchange") == 1 and "SinglePartition" in text and "partial_" in text
    assert "partial_count" in plan(defect_summary(stored.withColumn("defects", F.lit("D01"))))


def test_regression_is_one_aggregate(stored):
    text = plan(metric_tests(stored, stored))
    assert text.count("Exchange") == 1 and "Join" not in text


def test_no_cross_joins(stored):
    for df in (
        duplicate_ids(stored), validate_table(stored, "scored_results"), clean_results(stored)
    ):
        text = plan(df)
        assert "Cartesian" not in text and "NestedLoop" not in text


def test_running_sum_moves_rows_once(stored):
    """One shuffle of the rows by slice; beside it only per-slice totals are moved."""
    got = running_sum(stored.select("prompt_id", "unused"), ["prompt_id"], {"upto": "unused"})
    rows, shifts = plan(got).split("BroadcastExchange", 1)
    assert rows.count("Exchange hashpartitioning") == 1 and "rangepartitioning" not in rows
    assert "HashAggregate" in shifts and "partial_sum" in shifts


def test_few_repeated_ids_shuffle_no_rows(stored):
    assert "Exchange hashpartitioning" not in plan(duplicate_ids(stored))
    assert "Exchange hashpartitioning" not in plan(lint_prompts(stored))


def final_plan(df) -> str:
    df.collect()
    return plan(df)


def test_histogram_scores_once(stored):
    """The counts feed the range and the bins; the second use takes the shuffle of the first."""
    text = final_plan(overall_histogram(stored)).split("== Initial Plan ==")[0]
    scans = text.count("FileScan parquet")
    assert scans == 1 or "ReusedExchange" in text, text


def test_regression_report_reads_each_run_once(stored):
    text = plan(regression_report(stored, stored.withColumn("score_tone", F.col("score_tone") + 1)))
    assert text.count("FileScan parquet") == 2
    assert text.count("HashAggregate") == 2  # before and after one shuffle


def test_cleaning_moves_digests_only(stored):
    text = plan(clean_results(stored.select("prompt_id", "response", "grade")))
    single = text.split("Union")[1].split("Aggregate(")[0]  # the rows that occur once
    assert "Exchange hashpartitioning" not in single
