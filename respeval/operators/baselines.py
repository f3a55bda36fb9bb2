"""Baselines as sufficient statistics.

All that the regression tests need of a run is, per metric, its number of values, their mean and their squares
about it, and the number of each grade. These few rows are kept in place of the run. They merge, so
the statistics of days or parts add up to those of a whole baseline, and a run is tested against any number of
baselines with one pass over the run and none over theirs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respeval.functions.scores import GRADES
from respeval.operators.regression import (
    CONFIDENCE,
    GRADE_METRIC,
    LARGE_EFFECT,
    METRICS,
    MIN_SAMPLE,
    _tested,
    report_of_tests,
)
from respeval.sources.results import load_baseline

_COUNTS = ("graded", *(f"grade_{g}" for g in GRADES))
STATISTICS_SCHEMA = "metric string, rows bigint, n bigint, mean double, squares double, " + ", ".join(
    f"{c} bigint" for c in _COUNTS
)


def run_statistics(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per group of ``by``: a row for each metric of the table, and one for its grades if it has any.

    One aggregate, combined before the shuffle. Missing values and NaN are left out.
    """
    if "overall_score" not in df.columns:
        raise ValueError("a run needs an overall_score column")
    metrics = [m for m in METRICS if m in df.columns]
    graded = "grade" in df.columns
    aggregates = [F.count(F.lit(1)).alias("__rows")]
    for i, m in enumerate(metrics):
        value = F.col(m).cast("double")
        known = F.when(~F.isnan(value), value)
        aggregates += [
            F.count(known).alias(f"__n_{i}"),
            F.avg(known).alias(f"__mean_{i}"),
            (F.var_pop(known) * F.count(known)).alias(f"__squares_{i}"),
        ]
    if graded:
        aggregates.append(F.count("grade").alias("__graded"))
        aggregates += [F.count_if(F.col("grade") == g).alias(f"__grade_{g}") for g in GRADES]
    no_counts = [F.lit(None).cast("bigint").alias(c) for c in _COUNTS]
    rows = [
        F.struct(
            F.lit(METRICS[m]).alias("metric"),
            F.col("__rows").alias("rows"),
            F.col(f"__n_{i}").alias("n"),
            F.col(f"__mean_{i}").alias("mean"),
            F.col(f"__squares_{i}").alias("squares"),
            *no_counts,
        )
        for i, m in enumerate(metrics)
    ]
    if graded:
        rows.append(
            F.struct(
                F.lit(GRADE_METRIC).alias("metric"),
                F.col("__rows").alias("rows"),
                F.lit(None).cast("bigint").alias("n"),
                F.lit(None).cast("double").alias("mean"),
                F.lit(None).cast("double").alias("squares"),
                *[F.col(f"__{c}").alias(c) for c in _COUNTS],
            )
        )
    return df.groupBy(*by).agg(*aggregates).select(*by, F.inline(F.array(*rows)))


def merge_statistics(statistics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Statistics of the union of runs, per ``by``.

    The mean of all is found first, so squares are added up about it and lose no digits.
    """
    keys = [*by, "metric"]
    known = F.when(F.col("mean").isNotNull(), F.col("n"))
    means = statistics.groupBy(*keys).agg((F.sum(known * F.col("mean")) / F.sum(known)).alias("__mean"))
    means = means.select(*[F.col(k).alias(f"__{k}") for k in keys], "__mean")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    about = F.col("squares") + known * F.pow(F.col("mean") - F.col("__mean"), F.lit(2))
    return (
        statistics.join(means, same)
        .groupBy(*keys)
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("n").alias("n"),
            F.first("__mean").alias("mean"),
            F.sum(about).alias("squares"),
            *[F.sum(c).alias(c) for c in _COUNTS],
        )
    )


def compare_statistics(
    baselines: DataFrame,
    current: DataFrame,
    by: Sequence[str] = (),
    confidence: float = CONFIDENCE,
    min_sample: int = MIN_SAMPLE,
    effect: float = LARGE_EFFECT,
    rescale: bool = False,
) -> DataFrame:
    """``regression_report`` of one run against every baseline, from the statistics of both.

    ``by`` names the columns that tell the baselines apart; ``current`` has one row per metric, which is
    broadcast. A metric that a baseline or the run lacks is left out.
    """

    def side(df: DataFrame, s: str, keys: Sequence[str]) -> DataFrame:
        variance = F.try_divide(F.col("squares"), F.nullif(F.col("n") - 1, F.lit(0)))
        return df.select(
            *keys,
            F.col("metric").alias("metric" if s == "b" else "__metric"),
            F.coalesce("n", F.lit(0)).alias(f"n_{s}"),
            F.col("mean").alias(f"mean_{s}"),
            F.when(F.col("n") > 1, variance).alias(f"var_{s}"),
            F.col("rows").alias(f"rows_{s}"),
            *[F.col(c).alias(f"{c}_{s}") for c in _COUNTS],
        )

    theirs = side(baselines, "b", by)
    mine = F.broadcast(side(current, "c", ()))
    rows = theirs.join(mine, F.col("metric") == F.col("__metric"))
    grades = F.struct(*[f"{c}_{s}" for s in "bc" for c in _COUNTS])
    tests = _tested(rows.withColumn("grades", grades), [*by, "grades"])
    return report_of_tests(tests, True, confidence, min_sample, effect, rescale, by)


def save_statistics(run: DataFrame, path: str, name: str) -> None:
    """Keep the statistics of a run as the baseline ``name``; one of that name is replaced."""
    run_statistics(run).coalesce(1).write.mode("overwrite").parquet(f"{path}/baseline={name}")


def load_statistics(spark: SparkSession, path: str) -> DataFrame | None:
    """All kept baselines (baseline, and their statistics), or None if there is none yet."""
    return load_baseline(spark, path)
