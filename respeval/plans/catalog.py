"""The registered queries, one or more per operator."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from respeval.functions import cost as cost_functions
from respeval.functions import sanitize
from respeval.functions import text as tx
from respeval.functions.numbers import normalize_value
from respeval.functions.scores import HEURISTICS, TextFeatures, expected_grade
from respeval.operators import baselines, execute, prompts, quality, rates, regression, reports, running, summaries
from respeval.operators.costs import (
    PRICE_LIST_SCHEMA,
    cost_by_model,
    cost_summary,
    price_requests,
    row_cost,
)
from respeval.operators.scoring import (
    Criterion,
    Rubric,
    detect_defects,
    prompt_id,
    prompt_text,
    register_rule,
    response_text,
    score_responses,
    with_category_score,
)
from respeval.operators.tables import ragged_union
from respeval.plans import relations as rel
from respeval.plans import workflows
from respeval.sources import bucketed, checked
from respeval.sources import prompts as prompt_files
from respeval.sources import results as io
from respeval.sources.storage import work_path, write_and_read
from respeval.streaming import answers, budget, streams, trailing

BUDGET = 50.0
CALLS_PER_MINUTE = 60
USAGE_ORDER = ["ts", "event_id"]
CATEGORY = (
    "CASE model WHEN 'gpt-4' THEN 'accuracy' WHEN 'gpt-4-turbo' THEN 'reasoning' "
    "WHEN 'claude-3-sonnet' THEN 'tone' WHEN 'Claude-3-OPUS' THEN 'completeness' ELSE 'style' END"
)
RULE_TERMS = ["because", "THE ", "of"]
RULE_ENTITY = "License"
RULE_MAX_WORDS = 200
DIMENSIONS = list(HEURISTICS)


def r6(name: str) -> Column:
    return F.round(F.col(name), 6).alias(name)


def _from_features(spark: SparkSession, sf_dir: str, f: TextFeatures, **columns: Column):
    base = rel.responses(spark, sf_dir)
    named = [c.alias(name) for name, c in columns.items()]
    return f.add_to(base, response_text(base)).select("prompt_id", *named)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_responses(rel.responses(spark, sf_dir))


def filter_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = execute.filter_success(rel.responses(spark, sf_dir))
    return kept.select("prompt_id", "model", "status")


def prompt_text_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rel.load(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "CASE WHEN doc_id % 2 = 0 THEN 'd' || CAST(doc_id AS STRING) ELSE '' END AS id",
        "'p' || CAST(doc_id AS STRING) AS prompt_id",
        "CASE WHEN lang = 'en' THEN '' ELSE text END AS text",
        "CASE WHEN doc_id % 3 = 0 THEN NULL ELSE source END AS prompt_text",
        "CASE WHEN lang = 'fr' THEN '' ELSE lang END AS prompt",
    )
    return table.select(
        "doc_id",
        prompt_id(table).alias("prompt_id"),
        prompt_text(table).alias("for_scores"),
        prompt_text(table, ("prompt", "text")).alias("for_execution"),
        prompt_text(table, ("prompt", "prompt_text")).alias("for_cost"),
        prompt_text(table, ("prompt_text", "prompt")).alias("for_report"),
    )


SCORED_COLUMNS = [
    f"{prefix}{d}{suffix}"
    for d in DIMENSIONS
    for prefix, suffix in (("score_", ""), ("score_", "_raw"), ("", ""), ("", "_score"))
]


def _scored_view(scored: DataFrame) -> DataFrame:
    return scored.select(
        "prompt_id",
        "prompt_text",
        "model",
        "status",
        r6("aggregated_score"),
        r6("overall_score"),
        *[r6(c) for c in SCORED_COLUMNS],
        "score_accuracy_notes",
        "defects",
    )


def scored_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored_view(_scored(spark, sf_dir))


def text_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = TextFeatures()
    return _from_features(
        spark,
        sf_dir,
        f,
        n_words=f.n_words.cast("bigint"),
        logical_count=tx.count_markers(f.found, tx.LOGICAL).cast("bigint"),
        positive=f.has(tx.POSITIVE),
        negative=f.has(tx.NEGATIVE),
        polite=f.has(tx.POLITE),
        uncertain=f.has(tx.UNCERTAIN),
        bonus=f.has(tx.ACCURACY_BONUS),
        listed=f.listed,
    )


def unique_word_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = TextFeatures()
    ratio = F.round(f.unique_word_ratio, 6)
    return _from_features(spark, sf_dir, f, unique_word_ratio=ratio)


def _heuristic(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        f = TextFeatures()
        score = HEURISTICS[name](f).cast("bigint")
        return _from_features(spark, sf_dir, f, **{name: score})

    return query


def category_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rel.responses(spark, sf_dir).withColumn("category", F.expr(CATEGORY))
    return with_category_score(table).select(
        "prompt_id", "category", F.col("category_score").cast("bigint").alias("category_score")
    )


def normalized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.expr(
        "CASE user_id % 4 WHEN 0 THEN value WHEN 1 THEN -value WHEN 2 THEN value / 50 "
        "ELSE NULL END"
    )
    table = rel.load(spark, sf_dir, "events").select("event_id", value.alias("value"))
    return table.select(
        "event_id",
        F.round(normalize_value(F.col("value")), 6).alias("unscaled"),
        F.round(normalize_value(F.col("value"), 1.0, 40.0), 6).alias("scaled"),
        F.round(normalize_value(F.col("value"), 5.0, 5.0), 6).alias("bad_range"),
    )


def _rule(rule: str, **params):
    rubric = Rubric((Criterion("check", 1.0, "rule", {"rule": rule, **params}),))

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        scored = score_responses(rel.responses(spark, sf_dir), rubric, defects=False)
        return scored.select(
            "prompt_id", r6("score_check"), r6("score_check_raw"), "score_check_notes"
        )

    return query


def rule_of_the_caller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that the program adds: whether the number of words is even."""
    register_rule(
        "even_words",
        lambda f, params: ((f.n_words % 2 == 0).cast("double"), F.lit("even or odd")),
    )
    return _rule("even_words")(spark, sf_dir)


def judge_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    params = {"json_key": "k", "min_val": 0, "max_val": 100}
    rubric = Rubric((Criterion("judge", 1.0, "judge", params),))
    table = rel.derive(rel.load(spark, sf_dir, "events"), rel.JUDGE_TEXTS)
    scored = score_responses(table, rubric, defects=False)
    return scored.select(
        "event_id", r6("score_judge"), r6("score_judge_raw"), "score_judge_notes"
    )


def stored_defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Defects from stored scores: filled, unreadable and missing ones."""
    table = rel.responses(spark, sf_dir).selectExpr(
        "prompt_id",
        "model_response",
        "response",
        "CASE seq % 4 WHEN 0 THEN '1.5' WHEN 1 THEN 'bad' WHEN 2 THEN '4' END AS accuracy",
        "CAST(seq % 5 AS DOUBLE) AS accuracy_score",
        "CAST(seq % 6 AS DOUBLE) / 5 AS score_reasoning",
        "CAST(NULL AS DOUBLE) AS tone",
        "CAST(seq % 3 AS DOUBLE) + 1 AS tone_score",
    )
    found = detect_defects(table)
    return found.select("prompt_id", F.array_join("defects", ",").alias("defects"))


def assign_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return scored.select("prompt_id", expected_grade(F.col("overall_score")).alias("grade"))


def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rel.load(spark, sf_dir, "documents")
    return docs.select("doc_id", cost_functions.estimate_tokens(F.col("text")).alias("tokens"))


def normalize_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = rel.usage(spark, sf_dir)
    key = cost_functions.normalize_model(F.col("model"))
    return table.select("event_id", "model", key.alias("price_key"))


def row_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    priced = row_cost(rel.responses(spark, sf_dir))
    cost = F.round("cost", 8).alias("cost")
    return priced.select("prompt_id", "input_tokens", "output_tokens", cost)


def joined_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with the price list as a table."""
    rows = [(k, i, o) for k, (i, o) in cost_functions.PRICES.items()]
    prices = spark.createDataFrame(rows, PRICE_LIST_SCHEMA)
    priced = row_cost(rel.responses(spark, sf_dir), prices)
    cost = F.round("cost", 8).alias("cost")
    return priced.select("prompt_id", "input_tokens", "output_tokens", cost)


def _priced_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return price_requests(rel.usage(spark, sf_dir))


def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = cost_summary(_priced_usage(spark, sf_dir), BUDGET)
    return totals.withColumn("avg_tokens_per_request", r6("avg_tokens_per_request"))


def usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cost_by_model(_priced_usage(spark, sf_dir))


def cumulative_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    running_cost = running.cumulative_cost(_priced_usage(spark, sf_dir), USAGE_ORDER, ["run"])
    return running_cost.select(
        "run",
        "event_id",
        F.round("cumulative_cost", 8).alias("cumulative_cost"),
        "cumulative_tokens",
    )


def cumulative_cost_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    running_cost = running.cumulative_cost(_priced_usage(spark, sf_dir), USAGE_ORDER)
    cost = F.round("cumulative_cost", 8).alias("cumulative_cost")
    return running_cost.select("event_id", cost, "cumulative_tokens")


def budget_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    alerts = running.budget_alerts(_priced_usage(spark, sf_dir), BUDGET, USAGE_ORDER, ["run"])
    remaining = F.round("remaining", 8).alias("remaining")
    return alerts.select("run", "event_id", "alert", remaining)


def request_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = rel.load(spark, sf_dir, "events")
    rate = rates.request_rate(events, "ts", ["event_type"], CALLS_PER_MINUTE)
    return rate.select(
        "event_type", "ts", "requests", "calls_last_minute", r6("utilization_percent")
    )


def request_rate_per_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = rel.load(spark, sf_dir, "events").select("event_id", "event_type", "ts")
    rated = rates.with_request_rate(events, "ts", ["event_type"], CALLS_PER_MINUTE)
    return rated.select("event_id", "calls_last_minute", r6("utilization_percent"))


def report_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rel.derive(rel.load(spark, sf_dir, "pages"), rel.PAGE_RESPONSES)
    shown = score_responses(reports.first_rows(pages, ["seq"]))
    return reports.report_sample(shown, ["seq"]).select(
        "seq", "sample_id", "prompt", "model", r6("score"), "defects"
    )


def report_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = reports.report_statistics(_scored(spark, sf_dir))
    return stats.select("total_evaluations", *[r6(c) for c in stats.columns[1:]])


def executive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = reports.executive_summary(_scored(spark, sf_dir))
    return summary.select(
        "total_evaluations",
        *[r6(c) for c in ("average_score", "median_score", "std_dev", "success_rate")],
        "insight",
        "high_variance",
    )


def dimension_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    averages = reports.dimension_averages(_scored(spark, sf_dir))
    return averages.select("dimension", r6("average"), r6("display_average"))


def defect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.defect_summary(_scored(spark, sf_dir))


def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = reports.run_summary(row_cost(_scored(spark, sf_dir)))
    return summary.select(
        "total_evaluations",
        r6("average_score"),
        r6("success_rate"),
        "total_tokens",
        F.round("total_cost", 8).alias("total_cost"),
    )


def execution_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = reports.execution_summary(rel.responses(spark, sf_dir))
    return summary.select("total", "success", "failed", r6("success_rate"))


def _histogram_view(histogram: DataFrame) -> DataFrame:
    return histogram.select("bin", r6("low"), r6("high"), "count")


def accuracy_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram_view(reports.accuracy_histogram(_scored(spark, sf_dir)))


def overall_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram_view(reports.overall_histogram(_scored(spark, sf_dir)))


def lint_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rel.load(spark, sf_dir, "documents")
    table = docs.select(
        *[F.expr(sql).alias(name) for name, sql in rel.PROMPTS.items()],
        F.when(F.col("lang") == "es", F.array(F.lit("a"), F.lit(None)))
        .otherwise(F.array("source"))
        .alias("tags"),
        F.struct(
            F.expr("CAST(n_chars AS INT)").alias("min_tokens"), F.lit(5000).alias("max_tokens")
        ).alias("expected_criteria"),
    )
    linted = prompts.lint_prompts(table)
    return linted.select("doc_id", F.array_join(F.array_sort("issues"), ",").alias("issues"))


def pending_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = rel.load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    done = rel.load(spark, sf_dir, "labels").select("doc_id")
    return prompts.pending_prompts(asked, done, "doc_id")


def error_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    errors = rel.load(spark, sf_dir, "events").filter("event_type = 'error'")
    return execute.error_stats(rel.derive(errors, rel.FAILURES))


def _raw_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.derive(rel.load(spark, sf_dir, "documents"), rel.RAW_RESULTS)


def _dirty_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.derive(rel.load(spark, sf_dir, "documents"), rel.DIRTY_SCORES)


def _issues_view(issues: DataFrame) -> DataFrame:
    return issues.select("issue", "column", "rows", r6("percentage"))


def validate_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues_view(quality.validate_table(_raw_results(spark, sf_dir), "raw_results"))


def validate_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues_view(quality.validate_table(_dirty_scores(spark, sf_dir), "scored_results"))


def invalid_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.invalid_grades(_dirty_scores(spark, sf_dir))


def grade_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = quality.grade_consistency(_dirty_scores(spark, sf_dir))
    return wrong.select("prompt_id", r6("overall_score"), "grade", "expected_grade")


def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    repeated = quality.duplicate_ids(_raw_results(spark, sf_dir))
    return repeated.select("doc_id", "prompt_id")


def clean_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = quality.clean_results(_dirty_scores(spark, sf_dir))
    return cleaned.select(
        "prompt_id",
        "response",
        *[r6(c) for c in ("overall_score", "score_accuracy", "score_tone")],
        "grade",
    )


def quality_report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report_table(rel.load(spark, sf_dir, "documents"))


def _column_view(report: DataFrame) -> DataFrame:
    numbers = ("mean", "median", "std", "min", "max")
    return report.select(
        "column",
        "dtype",
        "null_count",
        r6("null_percentage"),
        "unique_values",
        *[F.round(c, 4).alias(c) for c in numbers],
    )


def quality_report_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = rel.load(spark, sf_dir, "lineitem")
    return _column_view(quality.quality_report_columns(items))


def quality_report_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The column report on a table with nulls and long texts."""
    return _column_view(quality.quality_report_columns(_dirty_scores(spark, sf_dir)))


def merged_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of the lines of each month, stored, and merged into one report on all columns.

    Median and distinct count are sketches; the report says whether they are within their stated errors,
    by counting once more.
    """
    items = rel.load(spark, sf_dir, "lineitem")
    monthly = summaries.summarize(items.withColumn("month", F.date_trunc("month", "l_shipdate")), ["month"])
    stored = write_and_read(monthly, "summaries")
    report = write_and_read(summaries.summary_report(summaries.merge_summaries(stored)), "report")
    exact = quality.quality_report_columns(items).select(
        F.col("column").alias("name"), F.col("unique_values").alias("exact")
    )
    medians = {r["column"]: r["median"] for r in report.collect() if r["median"] is not None}  # one per column
    ranks = [
        F.struct(
            F.lit(c).alias("ranked"),
            F.avg((items[c] < m).cast("double")).alias("low"),
            F.avg((items[c] <= m).cast("double")).alias("high"),
        )
        for c, m in medians.items()
    ]
    parts = items.agg(F.array(*ranks).alias("ranks")).select(F.inline("ranks"))
    off = F.greatest(F.col("low") - 0.5, 0.5 - F.col("high"))
    view = report.join(F.broadcast(exact), F.col("column") == F.col("name")).join(
        F.broadcast(parts), F.col("column") == F.col("ranked"), "left"
    )
    return view.select(
        "column", "dtype", "null_count", r6("null_percentage"),
        *[F.round(c, 4).alias(c) for c in ("mean", "std", "min", "max")],
        (F.abs(F.col("unique_values") - F.col("exact")) <= summaries.distinct_error() * F.col("exact")).alias("distinct_holds"),
        (off <= summaries.rank_error()).alias("median_holds"),
    )


def summary_of_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The executive summary of each model from summaries of its prompts' parts."""
    scored = _scored(spark, sf_dir).select("model", "aggregated_score", F.expr("crc32(prompt_id) % 5").alias("part"))
    parts = write_and_read(summaries.summarize(scored, ["model", "part"]), "summaries")
    merged = summaries.merge_summaries(parts, ["model"])
    summary = summaries.summary_of_scores(merged, "aggregated_score", ["model"])
    return summary.select(
        "model", "total_evaluations", *[r6(c) for c in ("average_score", "std_dev", "success_rate")],
        "insight", "high_variance",
    )


def _runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The scored answers, and a later run of the same prompts."""
    docs = rel.load(spark, sf_dir, "documents")
    columns = rel.DOC_RESPONSES | {"lang": "lang"}
    scored = score_responses(rel.derive(docs, columns), defects=False)
    baseline = scored.withColumn("grade", expected_grade(F.col("overall_score")))
    later = rel.derive(baseline, rel.LATER_RUN)
    return baseline, later.withColumn("grade", expected_grade(F.col("overall_score")))


def _run_with_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)
    return scored.withColumn("grade", expected_grade(F.col("overall_score")))


TEST_NUMBERS = ["baseline_mean", "current_mean", "percent_change", "cohens_d", "t_statistic"]


def metric_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = regression.metric_tests(*_runs(spark, sf_dir))
    return tests.select(
        "metric", "baseline_n", "current_n", *[r6(c) for c in TEST_NUMBERS], "degrees_of_freedom"
    )


def regression_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdicts = regression.metric_verdicts(*_runs(spark, sf_dir))
    return verdicts.select(
        "metric",
        *[r6(c) for c in ("t_statistic", "cohens_d", "p_value")],
        "is_significant",
        "is_large_effect",
        "is_regression",
        "is_improvement",
    )


GRADE_NUMBERS = ["baseline_fail_pct", "current_fail_pct", "chi2", "fail_increase", "p_value"]


def _grade_view(row: DataFrame) -> DataFrame:
    return row.select("metric", *[r6(c) for c in GRADE_NUMBERS], "is_regression")


def grade_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _grade_view(regression.grade_regression(*_runs(spark, sf_dir)))


def grade_regression_unequal(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline, _ = _runs(spark, sf_dir)
    return _grade_view(regression.grade_regression(baseline, _run_with_failures(spark, sf_dir)))


def grade_regression_rescaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    baseline, _ = _runs(spark, sf_dir)
    current = _run_with_failures(spark, sf_dir)
    return _grade_view(regression.grade_regression(baseline, current, rescale=True))


def grade_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _run_with_failures(spark, sf_dir).select("status", "grade")
    shares = regression.grade_distribution(runs, "status")
    return shares.select(
        "status", "grade", "count", r6("share"), "smoothed_count", r6("fail_pct")
    )


def regression_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _report_view(regression.regression_report(*_runs(spark, sf_dir)))


def _report_view(report: DataFrame) -> DataFrame:
    numbers = ("baseline_value", "current_value", "change", "effect", "statistic", "p_value")
    return report.select("metric", *[r6(c) for c in numbers], "status", "reason")


def statistics_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report from kept statistics: those of each model's part of the baseline, merged."""
    baseline, later = _runs(spark, sf_dir)
    parts = write_and_read(baselines.run_statistics(baseline, ["model"]), "statistics")
    whole = baselines.merge_statistics(parts)
    return _report_view(baselines.compare_statistics(whole, baselines.run_statistics(later)))


def baselines_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of the later run against each model's part of the baseline, from kept statistics."""
    baseline, later = _runs(spark, sf_dir)
    parts = write_and_read(baselines.run_statistics(baseline, ["model"]), "statistics")
    report = baselines.compare_statistics(parts, baselines.run_statistics(later), ["model"])
    report = report.filter(F.col("metric") != regression.GRADE_METRIC)
    view = _report_view(report.withColumn("metric", F.concat_ws(": ", "model", "metric")))
    return view.drop("reason")


def run_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    verdict = regression.run_verdict(regression.regression_report(*_runs(spark, sf_dir)))
    lists = ("regressions", "improvements", "stable_metrics")
    return verdict.select(
        "has_regression", "reason", *[F.array_join(c, ",").alias(c) for c in lists]
    )


def map_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def net_prices(chunk: pd.DataFrame) -> pd.DataFrame:
        net = chunk["l_extendedprice"] * (1 - chunk["l_discount"])
        return chunk[["l_orderkey", "l_linenumber"]].assign(net=net)

    items = rel.load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_extendedprice", "l_discount"
    )
    mapped = execute.map_chunks(
        items, net_prices, "l_orderkey bigint, l_linenumber int, net double"
    )
    return mapped.select("l_orderkey", "l_linenumber", r6("net"))


def execute_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def stub_model(text: str) -> str:
        if "license" in text.lower():
            raise ValueError("licensed text")
        return f"{len(text)} characters"

    asked = rel.load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.col("text")
    )
    results = execute.execute_prompts(asked, stub_model, "gpt-4")
    chars = F.length("prompt").cast("bigint").alias("prompt_chars")
    return results.select(
        "prompt_id", chars, "response", "model", "status", "error", "error_type"
    )


def execute_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that is lost after two of its batches, and started anew."""
    path = work_path(spark, "calls")
    asked = rel.load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")

    def stub_model(text: str) -> str:
        if "license" in text.lower():
            raise ValueError("licensed text")
        return f"{len(text)} characters"

    def lost(batch_id: int) -> None:
        if batch_id == 1:
            raise RuntimeError("lost")

    answers.submit_prompts(asked, path, per_file=100)
    try:
        answers.answer_questions(spark, path, stub_model, files_per_batch=2, then=lost)
    except StreamingQueryException:
        pass
    results = answers.execute_resumable(asked, stub_model, path)
    chars = F.length("prompt").cast("bigint").alias("prompt_chars")
    return results.select(
        "prompt_id", chars, "response", "model", "status", "error", "error_type"
    )


def ragged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = rel.load(spark, sf_dir, "customer").selectExpr(
        "c_custkey AS key", "c_name AS name", "c_acctbal AS balance", "c_mktsegment AS segment"
    )
    suppliers = rel.load(spark, sf_dir, "supplier").selectExpr(
        "s_suppkey AS key", "s_name AS name", "s_acctbal AS balance", "s_nationkey AS nation"
    )
    return ragged_union(customers, suppliers)


def sanitize_string(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rel.load(spark, sf_dir, "pages")
    return pages.select("page_id", sanitize.sanitize_string(F.col("html")).alias("html"))


def sanitize_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rel.load(spark, sf_dir, "pages")
    return pages.select("page_id", sanitize.sanitize_filename(F.col("url")).alias("filename"))


def sanitize_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rel.load(spark, sf_dir, "pages").selectExpr(
        "page_id",
        "named_struct('url', ' ' || url || ' ', 'page id', page_id, "
        "'parts', split(html, '</p>'), 'meta', map(' html ', html, 'url', url)) AS page",
    )
    kind = pages.schema["page"].dataType
    clean = pages.select("page_id", sanitize.sanitize_value(F.col("page"), kind).alias("page"))
    return clean.select(
        "page_id",
        F.col("page.url").alias("url"),
        F.col("page.`page id`").alias("inner_id"),
        F.array_join("page.parts", "|").alias("parts"),
        F.array_join(F.map_keys("page.meta"), "|").alias("meta_keys"),
        F.try_element_at("page.meta", F.lit("html")).alias("meta_html"),
    )


def key_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rel.load(spark, sf_dir, "documents")
    shaped = F.filter(tx.words(F.col("text")), sanitize.valid_key_shape)
    return docs.select("doc_id", F.array_join(F.array_sort(shaped), " ").alias("keys"))


def html_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = rel.load(spark, sf_dir, "pages")
    return pages.select("page_id", sanitize.html_escape(F.col("html")).alias("html"))


def _round_trip(fmt: str):
    """The documents, line breaks and quotes included, through a file format and back."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        docs = rel.load(spark, sf_dir, "documents")
        path = work_path(spark, f"round-trip-{fmt}")
        io.save_responses(docs, path, fmt)
        schema = "doc_id bigint, lang string, n_chars bigint, source string, text string"
        if fmt == "csv":
            return io.load_typed_results(spark, path, schema)
        return spark.read.schema(schema).format(fmt).load(path)

    return query


def load_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as a result file, read back as text columns."""
    path = work_path(spark, "results")
    io.save_responses(rel.load(spark, sf_dir, "documents"), path, "csv")
    return io.load_results(spark, path)


def _broken_lines(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The documents as CSV lines without a header: some numbers are no numbers, some lines end early or late."""
    docs = rel.load(spark, sf_dir, "documents").selectExpr(
        "doc_id",
        "CAST(doc_id AS STRING) AS id",
        "lang",
        "CASE WHEN doc_id % 20 = 7 THEN 'many' ELSE CAST(n_chars AS STRING) END AS n_chars",
        "text",
    )
    line = F.to_csv(F.struct("id", "lang", "n_chars", "text"), {**io.CSV_OPTIONS, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false", "header": "false"})
    cut = F.concat_ws(",", "id", "lang")
    late = F.concat(line, F.lit(",more"))
    kind = F.col("doc_id") % 20
    docs.select(F.when(kind == 8, cut).when(kind == 9, late).otherwise(line).alias("value")).write.text(path)


CHECKED_SCHEMA = "id bigint, lang string, n_chars bigint, text string"


def _checked_view(good: DataFrame, bad: DataFrame) -> DataFrame:
    """Good rows, and the id at the start of a reject's text with the reason."""
    found = good.select(F.col("id").alias("doc_id"), "lang", "n_chars", "text", F.lit(None).cast("string").alias("reason"))
    number = F.regexp_extract("text", "^([0-9]+)", 1).cast("bigint").alias("doc_id")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("lang", "string"), ("n_chars", "bigint"), ("text", "string"))]
    return found.unionByName(bad.select(number, *nothing, "reason"))


def rejected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with broken records: all others as rows, and what is wrong with those."""
    path = work_path(spark, "broken")
    _broken_lines(spark, sf_dir, path)
    read = checked.read_checked(spark, path, CHECKED_SCHEMA, header=False)
    return _checked_view(checked.good_rows(read), checked.rejects(read))


def stream_rejected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream of files."""
    path = work_path(spark, "broken")
    _broken_lines(spark, sf_dir, f"{path}/in")
    stream = checked.stream_checked(spark, f"{path}/in", CHECKED_SCHEMA, header=False, files_per_batch=4)
    streams.run_available(stream, checked.checked_sink(f"{path}/out"), f"{path}/checkpoint")
    good = spark.read.schema(f"{CHECKED_SCHEMA}, batch_id bigint").parquet(f"{path}/out/good")
    bad = spark.read.schema("file string, text string, reason string, batch_id bigint").parquet(f"{path}/out/rejects")
    return _checked_view(good, bad)


def _streamed_csv(table: str, columns: dict[str, str], multi_line: bool):
    """A table as CSV files, at least four and as many as its size calls for, and back as a stream of them in two batches."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = work_path(spark, "stream-csv")
        rows = rel.load(spark, sf_dir, table).select(*columns)
        files = io.file_count(rows, least=4)
        io.save_responses(rows.repartition(files), f"{path}/in", "csv")
        schema = ", ".join(f"{c} {t}" for c, t in sorted(columns.items()))
        stream = io.stream_results(spark, f"{path}/in", schema, files_per_batch=-(-files // 2), multi_line=multi_line)
        return _persist(spark, stream, "streamed")

    return query


def _in_buckets(spark: SparkSession, df: DataFrame, key: str) -> DataFrame:
    path = work_path(spark, "buckets")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    bucketed.save_bucketed(df, name, path, key, 8)
    return bucketed.load_bucketed(spark, name)


def pending_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = rel.load(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    done = rel.load(spark, sf_dir, "labels").select("doc_id")
    return bucketed.pending_in_buckets(_in_buckets(spark, asked, "doc_id"), _in_buckets(spark, done, "doc_id"), "doc_id")


def repeated_in_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _in_buckets(spark, _raw_results(spark, sf_dir).select("doc_id", "prompt_id"), "prompt_id")
    return bucketed.repeated_in_buckets(raw).select("doc_id", "prompt_id")


def load_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt files of up to 200 parts each, written and loaded."""
    path = work_path(spark, "prompts")
    prompt = F.struct(
        F.concat(F.lit("part_"), F.col("p_partkey").cast("string")).alias("id"),
        F.col("p_name").alias("text"),
        F.col("p_brand").alias("category"),
        F.array("p_brand", "p_type").alias("tags"),
        F.struct(F.col("p_size").cast("int").alias("max_tokens")).alias("expected_criteria"),
    )
    files = (
        rel.load(spark, sf_dir, "part")
        .groupBy(F.floor(F.col("p_partkey") / 200).alias("file"))
        .agg(F.collect_list(prompt).alias("prompts"))
    )
    content = F.to_json(F.struct("prompts"))
    files.select("file", content.alias("value")).write.partitionBy("file").text(path)
    loaded = prompt_files.load_prompts(spark, f"{path}/*")
    tags = F.array_join("tags", ",").alias("tags")
    return loaded.select("id", "text", "category", tags, "expected_criteria.max_tokens")


def exported_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage log as exported and read back."""
    path = work_path(spark, "usage-log")
    usage = _priced_usage(spark, sf_dir).withColumn(
        "prompt_id", F.concat(F.lit("evt_"), F.col("event_id").cast("string"))
    )
    io.export_usage_log(usage, path, BUDGET)
    schema = (
        "prompt_id string, model string, input_tokens bigint, output_tokens bigint, cost double"
    )
    return spark.read.schema(schema).json(f"{path}/usage_log")


def stored_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A later run against a stored baseline."""
    baseline, later = _runs(spark, sf_dir)
    path = work_path(spark, "baseline")
    io.save_as_baseline(baseline.select(*regression.METRICS, "grade"), path)
    report = regression.regression_report(io.load_baseline(spark, path), later)
    return report.select("metric", "status")


def _persist(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Run a stream into a folder and read the folder."""
    path = work_path(spark, name)
    sink = streams.persist_batches(f"{path}/out")
    streams.run_available(stream, sink, f"{path}/checkpoint")
    return streams.read_persisted(spark, f"{path}/out", stream)


def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = rel.load_stream(spark, sf_dir, "documents")
    scored = streams.score_stream(rel.derive(docs, rel.DOC_RESPONSES))
    stored = _persist(spark, scored.drop("model_response", "response", "prompt"), "stream-score")
    return _scored_view(stored)


def stream_persist(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = rel.load_stream(spark, sf_dir, "events")
    return _persist(spark, events, "stream-persist")


def result_callback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a callback on each stored batch saw: rows by type, added up."""
    path = work_path(spark, "callback")

    def seen(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"))
        streams.persist_batches(f"{path}/seen")(counts, batch_id)

    sink = streams.persist_batches(f"{path}/out")
    events = rel.load_stream(spark, sf_dir, "events")
    streams.run_available(events, sink, f"{path}/checkpoint", then=seen)
    rows = spark.read.schema("event_type string, rows bigint").parquet(f"{path}/seen")
    return rows.groupBy("event_type").agg(F.sum("rows").alias("rows"))


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of a run as its file holds it."""
    path = work_path(spark, "reports")
    scored = _scored(spark, sf_dir)
    schema = reports.defect_summary(scored).schema
    written = workflows.write_reports(scored, path)
    return spark.read.schema(schema).json(written["defect_summary"])


def stream_request_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = rel.load_stream(spark, sf_dir, "events")
    rate = streams.rate_stream(events, "ts", ["event_type"], CALLS_PER_MINUTE)
    stored = _persist(spark, rate, "stream-rate")
    return stored.select(
        "event_type",
        F.col("window_start").cast("timestamp_ntz").alias("window_start"),
        "calls",
        r6("utilization_percent"),
    )


def stream_trailing_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact rate at every instant of the minutes that the stream has closed."""
    events = rel.load_stream(spark, sf_dir, "events")
    rate = trailing.trailing_minute_stream(events, "ts", ["event_type"], CALLS_PER_MINUTE)
    stored = _persist(spark, rate, "stream-trailing")
    return stored.select(
        "event_type",
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        "requests",
        "calls_last_minute",
        r6("utilization_percent"),
    )


def _arrivals(
    spark: SparkSession, path: str, table: DataFrame, run: Callable[[DataFrame], StreamingQuery]
) -> None:
    """The rows arrive in three parts, with the time of each; ``run`` goes on from its checkpoint after every part.

    A part has as many files as there were tasks that read the table.
    """
    # A stream's watermark begins at 1970, so arrivals lie well after it.
    timed = table.withColumn("at", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("doc_id")))
    for i in range(3):
        timed.filter(F.pmod(F.col("doc_id"), F.lit(3)) == i).write.mode("append").parquet(path)
        run(spark.readStream.schema(timed.schema).parquet(path))


def stream_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results that arrive in three batches, copies among them in any, cleaned as they come."""
    docs = rel.load(spark, sf_dir, "documents")
    results = rel.derive(docs, rel.DIRTY_SCORES | {"doc_id": "doc_id"})
    path = work_path(spark, "stream-clean")

    def run(arrived: DataFrame) -> StreamingQuery:
        cleaned = streams.clean_stream(arrived, "at", "1000 days", ignore=["at", "doc_id"])
        return streams.run_available(cleaned, streams.persist_batches(f"{path}/out"), f"{path}/checkpoint")

    _arrivals(spark, f"{path}/in", results, run)
    return streams.read_persisted(spark, f"{path}/out", results).select(
        "prompt_id",
        "response",
        *[r6(c) for c in ("overall_score", "score_accuracy", "score_tone")],
        "grade",
    )


def stream_repeated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids that recur in a stream of raw results, with their last counts."""
    path = work_path(spark, "stream-ids")

    def run(arrived: DataFrame) -> StreamingQuery:
        repeated = streams.repeated_id_stream(arrived, "at", "prompt_id", "3650 days")
        return streams.run_updates(repeated, f"{path}/out", f"{path}/checkpoint")

    _arrivals(spark, f"{path}/in", _raw_results(spark, sf_dir).select("doc_id", "prompt_id"), run)
    stored = spark.read.schema("prompt_id string, n bigint, batch_id bigint").parquet(f"{path}/out")
    return stored.groupBy("prompt_id").agg(F.max("n").alias("n"))


def stream_usage_by_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    usage = price_requests(rel.derive(rel.load_stream(spark, sf_dir, "events"), rel.USAGE))
    totals = streams.usage_stream(usage)
    path = work_path(spark, "stream-usage")
    streams.run_totals(totals, f"{path}/out", f"{path}/checkpoint")
    latest = streams.read_latest(spark, f"{path}/out", totals)
    return latest.select("model", "requests", "total_tokens", r6("cost"))


def stream_budget_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The usage arrives in four parts, in order; the stream goes on from its checkpoint each time.

    Parts begin with requests whose cost is not known. State and alerts follow at the end, batch by batch.
    """
    path = work_path(spark, "stream-budget")
    parts = running.slice_table(rel.usage(spark, sf_dir), USAGE_ORDER, 4).persist()
    schema = parts.drop(running.SLICE).schema
    for i in range(4):
        part = parts.filter(F.col(running.SLICE) == i).drop(running.SLICE)
        part.write.mode("append").parquet(f"{path}/in")
        usage = price_requests(spark.readStream.schema(schema).parquet(f"{path}/in"))
        usage = usage.withColumn("cost", F.expr(rel.KNOWN_COST))
        if i == 3:
            alerts = budget.follow_budget(usage, f"{path}/out", BUDGET, USAGE_ORDER, f"{path}/checkpoint")
        else:
            streams.run_available(usage, budget.usage_sink(f"{path}/out", USAGE_ORDER), f"{path}/checkpoint")
    parts.unpersist()
    remaining = F.round(F.lit(BUDGET) - F.col("cumulative_cost"), 8).alias("remaining")
    return alerts.select("run", "event_id", "alert", remaining)


QUERIES = {
    "filter_success": filter_success,
    "prompt_text_coalesce": prompt_text_coalesce,
    "text_features": text_features,
    "unique_word_ratio": unique_word_ratio,
    "score_accuracy": _heuristic("accuracy"),
    "score_reasoning": _heuristic("reasoning"),
    "score_tone": _heuristic("tone"),
    "score_completeness": _heuristic("completeness"),
    "category_score": category_score,
    "normalize_value": normalized_values,
    "rule_contains_terms": _rule("contains_terms", terms=RULE_TERMS, min_match=2),
    "rule_mentions_entity": _rule("mentions_entity", entity=RULE_ENTITY),
    "rule_length_within": _rule("length_within", max_len=RULE_MAX_WORDS),
    "rule_of_the_caller": rule_of_the_caller,
    "load_results": load_results,
    "rejected_records": rejected_records,
    "stream_rejected_records": stream_rejected_records,
    "stream_csv": _streamed_csv(
        "documents", {"doc_id": "bigint", "lang": "string", "n_chars": "bigint", "source": "string", "text": "string"}, True
    ),
    "stream_csv_lines": _streamed_csv(
        "customer", {"c_custkey": "bigint", "c_name": "string", "c_acctbal": "double"}, False
    ),
    "pending_in_buckets": pending_in_buckets,
    "repeated_in_buckets": repeated_in_buckets,
    "load_prompts": load_prompts,
    "result_callback": result_callback,
    "report_files": report_files,
    "judge_score": judge_scores,
    "score_responses": scored_responses,
    "detect_defects": stored_defects,
    "assign_grade": assign_grade,
    "token_estimate": token_estimate,
    "normalize_model": normalize_model,
    "row_cost": row_costs,
    "row_cost_joined": joined_costs,
    "cost_summary": usage_totals,
    "cost_by_model": usage_by_model,
    "cumulative_cost": cumulative_cost,
    "cumulative_cost_overall": cumulative_cost_overall,
    "budget_alerts": budget_alerts,
    "request_rate": request_rate,
    "request_rate_per_request": request_rate_per_request,
    "report_sample": report_sample,
    "report_statistics": report_statistics,
    "executive_summary": executive_summary,
    "dimension_averages": dimension_averages,
    "defect_summary": defect_summary,
    "run_summary": run_summary,
    "execution_summary": execution_summary,
    "accuracy_histogram": accuracy_histogram,
    "overall_histogram": overall_histogram,
    "lint_prompts": lint_prompts,
    "pending_prompts": pending_prompts,
    "error_stats": error_stats,
    "validate_raw": validate_raw,
    "validate_scored": validate_scored,
    "invalid_grades": invalid_grades,
    "grade_consistency": grade_consistency,
    "duplicate_ids": duplicate_ids,
    "clean_results": clean_results,
    "quality_report_table": quality_report_table,
    "quality_report_columns": quality_report_columns,
    "quality_report_scores": quality_report_scores,
    "merged_summaries": merged_summaries,
    "summary_of_scores": summary_of_scores,
    "metric_regression": metric_regression,
    "regression_verdict": regression_verdict,
    "grade_regression": grade_regression,
    "grade_regression_unequal": grade_regression_unequal,
    "grade_regression_rescaled": grade_regression_rescaled,
    "grade_distribution": grade_distribution,
    "regression_report": regression_report,
    "statistics_report": statistics_report,
    "baselines_report": baselines_report,
    "run_verdict": run_verdict,
    "map_chunks": map_chunks,
    "execute_prompts": execute_prompts,
    "execute_resumed": execute_resumed,
    "ragged_union": ragged_tables,
    "sanitize_string": sanitize_string,
    "sanitize_filename": sanitize_filename,
    "sanitize_nested": sanitize_nested,
    "key_shape": key_shapes,
    "html_escape": html_escape,
    "csv_round_trip": _round_trip("csv"),
    "json_round_trip": _round_trip("json"),
    "export_usage_log": exported_usage,
    "save_as_baseline": stored_baseline,
    "stream_score": stream_score,
    "stream_persist": stream_persist,
    "stream_request_rate": stream_request_rate,
    "stream_trailing_minute": stream_trailing_minute,
    "stream_clean": stream_clean,
    "stream_repeated_ids": stream_repeated_ids,
    "stream_usage_by_model": stream_usage_by_model,
    "stream_budget_alerts": stream_budget_alerts,
}
