"""Comparison of a run with a baseline: t-test and effect size per metric, grades by chi-square."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval.functions.scores import DEFAULT_WEIGHTS, GRADES
from respeval.functions.stats import chi_square_tail_4, t_p_value

# Thresholds of the verdicts.
CONFIDENCE = 0.95
LARGE_EFFECT = 0.3
FAIL_RISE_POINTS = 10.0
MIN_SAMPLE = 5
GRADE_METRIC = "Grade Distribution"
NO_BASELINE = "No baseline available"
TOO_FEW = "Insufficient samples (need at least %d)"

METRICS = {"overall_score": "Overall Score"} | {
    f"score_{d}": d.capitalize() for d in DEFAULT_WEIGHTS
}


def _shared_metrics(baseline: DataFrame, current: DataFrame) -> list[str]:
    both = set(baseline.columns) & set(current.columns)
    if "overall_score" not in both:
        raise ValueError("both runs need an overall_score column")
    return [m for m in METRICS if m in both]


def _together(baseline: DataFrame, current: DataFrame, names: list[str]) -> DataFrame:
    def tagged(df: DataFrame, is_current: bool) -> DataFrame:
        return df.select(*names, F.lit(is_current).alias("is_current"))

    return tagged(baseline, False).unionByName(tagged(current, True))


def _sides() -> dict[str, Column]:
    return {"b": ~F.col("is_current"), "c": F.col("is_current")}


def _metric_aggregates(metrics: list[str]) -> list[Column]:
    out = [F.count_if(side).alias(f"rows_{s}") for s, side in _sides().items()]
    for i, m in enumerate(metrics):
        value = F.col(m).cast("double")
        known = F.when(~F.isnan(value), value)
        for s, side in _sides().items():
            on_side = F.when(side, known)
            out += [
                F.count(on_side).alias(f"n_{s}_{i}"),
                F.avg(on_side).alias(f"mean_{s}_{i}"),
                F.var_samp(on_side).alias(f"var_{s}_{i}"),
            ]
    return out


def _grade_aggregates() -> list[Column]:
    out = []
    for s, side in _sides().items():
        out.append(F.count(F.when(side, F.col("grade"))).alias(f"graded_{s}"))
        out += [
            F.count_if(side & (F.col("grade") == g)).alias(f"grade_{g}_{s}") for g in GRADES
        ]
    return out


def _metric_rows(wide: DataFrame, metrics: list[str], graded: bool = False) -> DataFrame:
    """One row per metric with sizes, means, effect size and t statistic.

    With ``graded`` there is one more row, for the grades, and all rows have the struct ``grades``.
    All come out of one generator, so what is below it is computed once.
    """
    parts = [(p, s) for p in ("n", "mean", "var") for s in ("b", "c")]
    kinds = dict(wide.dtypes)
    of_grades = [c for c in wide.columns if c.startswith("grade")] if graded else []
    rest = ["rows_b", "rows_c", *([F.struct(*of_grades).alias("grades")] if graded else [])]
    structs = [
        F.struct(
            F.lit(METRICS[m]).alias("metric"),
            *[F.col(f"{p}_{s}_{i}").alias(f"{p}_{s}") for p, s in parts],
            *rest,
        )
        for i, m in enumerate(metrics)
    ]
    if graded:
        nothing = [F.lit(None).cast(kinds[f"{p}_{s}_0"]).alias(f"{p}_{s}") for p, s in parts]
        structs.append(F.struct(F.lit(GRADE_METRIC).alias("metric"), *nothing, *rest))
    return _tested(wide.select(F.inline(F.array(*structs))), ["grades"] if graded else [])


def _tested(rows: DataFrame, others: Sequence[str] = ()) -> DataFrame:
    """Rows (metric, n_b, n_c, mean_b, mean_c, var_b, var_c, rows_b, rows_c) with effect size and t statistic."""
    n_b, n_c = F.col("n_b"), F.col("n_c")
    var_b, var_c = F.col("var_b"), F.col("var_c")
    change = F.col("mean_c") - F.col("mean_b")
    # The effect size takes the plain mean of both variances, the test the pooled one.
    spread = F.sqrt((var_b + var_c) / 2)
    freedom = n_b + n_c - 2
    pooled = F.try_divide((n_b - 1) * var_b + (n_c - 1) * var_c, freedom)
    error = F.sqrt(pooled * (F.try_divide(F.lit(1.0), n_b) + F.try_divide(F.lit(1.0), n_c)))
    infinite = F.signum(change) * F.lit(float("inf"))
    return rows.select(
        "metric",
        n_b.alias("baseline_n"),
        n_c.alias("current_n"),
        F.col("mean_b").alias("baseline_mean"),
        F.col("mean_c").alias("current_mean"),
        F.when(F.col("mean_b") == 0, 0.0)
        .otherwise(F.try_divide(change, "mean_b") * 100)
        .alias("percent_change"),
        F.when(spread > 0, change / spread).otherwise(0.0).alias("cohens_d"),
        F.when(error > 0, change / error)
        .when((error == 0) & (change != 0), infinite)
        .alias("t_statistic"),
        freedom.cast("double").alias("degrees_of_freedom"),
        "rows_b",
        "rows_c",
        *others,
    )


def metric_tests(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """Per metric both runs have: means, change in percent, Cohen's d, t and its freedom.

    All metrics of both runs are reduced in one aggregate, so only one row per task is shuffled.
    """
    metrics = _shared_metrics(baseline, current)
    wide = _together(baseline, current, metrics).agg(*_metric_aggregates(metrics))
    return _metric_rows(wide, metrics).drop("rows_b", "rows_c")


def _verdicts(tests: DataFrame, confidence: float, effect: float) -> DataFrame:
    alpha = 1 - confidence
    judged = tests.withColumn("p_value", t_p_value("t_statistic", "degrees_of_freedom"))
    significant = F.coalesce(F.col("p_value") < alpha, F.lit(False))
    large = F.abs("cohens_d") > effect
    worse = F.coalesce(F.col("current_mean") < F.col("baseline_mean"), F.lit(False))
    return judged.select(
        "*",
        significant.alias("is_significant"),
        large.alias("is_large_effect"),
        (significant & large & worse).alias("is_regression"),
        (significant & large & ~worse).alias("is_improvement"),
    )


def metric_verdicts(
    baseline: DataFrame,
    current: DataFrame,
    confidence: float = CONFIDENCE,
    effect: float = LARGE_EFFECT,
) -> DataFrame:
    """``metric_tests`` with the two-sided p-value and whether it is a regression."""
    return _verdicts(metric_tests(baseline, current), confidence, effect)


def grade_distribution(runs: DataFrame, run: str = "run") -> DataFrame:
    """Per run and grade: count, share of the graded rows, smoothed count, and the fail rate."""
    wide = runs.groupBy(run).agg(
        F.count("grade").alias("graded"),
        *[F.count_if(F.col("grade") == g).alias(f"grade_{g}") for g in GRADES],
    )
    fails = F.col("grade_D") + F.col("grade_F")
    rows = [
        F.struct(
            F.lit(g).alias("grade"),
            F.col(f"grade_{g}").alias("count"),
            F.coalesce(F.try_divide(F.col(f"grade_{g}"), "graded"), F.lit(0.0)).alias("share"),
            (F.col(f"grade_{g}") + 1).alias("smoothed_count"),
            F.coalesce(F.try_divide(fails, "graded") * 100, F.lit(0.0)).alias("fail_pct"),
        )
        for g in GRADES
    ]
    return wide.select(run, F.inline(F.array(*rows)))


def _with_grade_test(wide: DataFrame, confidence: float, rescale: bool) -> DataFrame:
    """Add fail rates, their rise, chi-square, its p-value and the verdict to the grade counts."""

    def smoothed(grade: str, side: str) -> Column:
        return F.col(f"grade_{grade}_{side}") + 1

    def fail_pct(side: str) -> Column:
        fails = F.col(f"grade_D_{side}") + F.col(f"grade_F_{side}")
        return F.coalesce(F.try_divide(fails, F.col(f"graded_{side}")) * 100, F.lit(0.0))

    total_b = sum((smoothed(g, "b") for g in GRADES), F.lit(0))
    total_c = sum((smoothed(g, "c") for g in GRADES), F.lit(0))
    scale = total_c / total_b if rescale else F.lit(1.0)
    chi2 = F.lit(0.0)
    for g in GRADES:
        expected = smoothed(g, "b") * scale
        chi2 = chi2 + F.pow(smoothed(g, "c") - expected, F.lit(2)) / expected
    # A goodness-of-fit test needs equal totals. Without them there is no test, and no regression.
    testable = F.lit(True) if rescale else total_b == total_c
    rise = F.col("current_fail_pct") - F.col("baseline_fail_pct")
    worse = (F.col("fail_increase") > FAIL_RISE_POINTS) & (F.col("grade_p_value") < 1 - confidence)
    return (
        wide.withColumns(
            {
                "baseline_fail_pct": fail_pct("b"),
                "current_fail_pct": fail_pct("c"),
                "chi2": F.when(testable, chi2).otherwise(0.0),
            }
        )
        .withColumns({"fail_increase": rise, "grade_p_value": chi_square_tail_4(F.col("chi2"))})
        .withColumn("grades_worse", worse)
    )


def grade_regression(
    baseline: DataFrame,
    current: DataFrame,
    confidence: float = CONFIDENCE,
    rescale: bool = False,
) -> DataFrame:
    """One row: fail rates, their rise, chi-square of the smoothed grade counts, verdict.

    With runs of unequal size the test is only made if ``rescale`` brings the baseline counts to
    the size of the current run.
    """
    sides = [F.count_if(side).alias(f"rows_{s}") for s, side in _sides().items()]
    wide = _together(baseline, current, ["grade"]).agg(*sides, *_grade_aggregates())
    return _with_grade_test(wide, confidence, rescale).select(
        F.lit(GRADE_METRIC).alias("metric"),
        "baseline_fail_pct",
        "current_fail_pct",
        "chi2",
        "fail_increase",
        F.col("grade_p_value").alias("p_value"),
        F.col("grades_worse").alias("is_regression"),
    )


REPORT_SCHEMA = (
    "metric string, baseline_value double, current_value double, change double, "
    "effect double, statistic double, p_value double, status string, reason string"
)


def regression_report(
    baseline: DataFrame | None,
    current: DataFrame,
    confidence: float = CONFIDENCE,
    min_sample: int = MIN_SAMPLE,
    effect: float = LARGE_EFFECT,
    rescale: bool = False,
) -> DataFrame:
    """One row per metric plus one for the grades, with status and, if not tested, the reason.

    Status is ``regression``, ``improvement``, ``stable`` or ``skipped``. Both runs are read once.
    """
    if baseline is None:
        row = (None,) * 7 + ("skipped", NO_BASELINE)
        return current.sparkSession.createDataFrame([row], REPORT_SCHEMA)
    metrics = _shared_metrics(baseline, current)
    graded = "grade" in baseline.columns and "grade" in current.columns
    names = metrics + (["grade"] if graded else [])
    wide = _together(baseline, current, names).agg(
        *_metric_aggregates(metrics), *(_grade_aggregates() if graded else [])
    )
    return report_of_tests(_metric_rows(wide, metrics, graded), graded, confidence, min_sample, effect, rescale)


def report_of_tests(
    tests: DataFrame,
    graded: bool,
    confidence: float = CONFIDENCE,
    min_sample: int = MIN_SAMPLE,
    effect: float = LARGE_EFFECT,
    rescale: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """The report of rows from ``_tested``; with ``graded`` they have the struct ``grades`` of both sides."""
    few = (F.col("rows_b") < min_sample) | (F.col("rows_c") < min_sample)
    reason = F.when(few, TOO_FEW % min_sample)

    def status(regression: Column, improvement: Column) -> Column:
        return (
            F.when(few, "skipped")
            .when(regression, "regression")
            .when(improvement, "improvement")
            .otherwise("stable")
        )

    judged = _verdicts(tests, confidence, effect)
    values = {
        "baseline_value": F.col("baseline_mean"),
        "current_value": F.col("current_mean"),
        "change": F.col("percent_change"),
        "effect": F.col("cohens_d"),
        "statistic": F.col("t_statistic"),
        "p_value": F.col("p_value"),
        "status": status(F.col("is_regression"), F.col("is_improvement")),
    }
    if graded:
        judged = _with_grade_test(judged.select("*", "grades.*"), confidence, rescale)
        of_grades = {
            "baseline_value": F.col("baseline_fail_pct"),
            "current_value": F.col("current_fail_pct"),
            "change": F.col("fail_increase"),
            "effect": F.lit(None).cast("double"),
            "statistic": F.col("chi2"),
            "p_value": F.col("grade_p_value"),
            "status": status(F.col("grades_worse"), F.lit(False)),
        }
        is_grades = F.col("metric") == GRADE_METRIC
        values = {k: F.when(is_grades, of_grades[k]).otherwise(v) for k, v in values.items()}
    return judged.select(*by, "metric", *[v.alias(k) for k, v in values.items()], reason.alias("reason"))


def run_verdict(report: DataFrame) -> DataFrame:
    """One row: whether anything regressed, why nothing was tested, and the metrics by status.

    A report has one row per metric, so the lists are short. A grade distribution that did not
    get worse is not listed as stable.
    """

    def listed(status: str, *, grades: bool) -> Column:
        of_status = F.col("status") == status
        if not grades:
            of_status = of_status & (F.col("metric") != GRADE_METRIC)
        return F.array_sort(F.collect_list(F.when(of_status, F.col("metric"))))

    return report.agg(
        F.bool_or(F.col("status") == "regression").alias("has_regression"),
        F.max("reason").alias("reason"),
        listed("regression", grades=True).alias("regressions"),
        listed("improvement", grades=True).alias("improvements"),
        listed("stable", grades=False).alias("stable_metrics"),
    )
