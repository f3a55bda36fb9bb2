"""Column summaries that can be kept and merged.

A summary row describes one column of one group of rows, such as a day or a delivery: exact counts, mean,
squares about the mean, extremes, a KLL sketch of the values and an HLL sketch of what is distinct. Rows of
many groups merge into the summary of all their rows, so a report on a long history reads summaries
in place of rows. A table is summarised in one aggregate, combined before the shuffle; a merged summary is as
large as a single one.

All numbers but two are those of the whole table. A quantile from a sketch has a rank within
``rank_error`` of the one asked for, and a distinct count is within ``distinct_error``, for a single sketch as for a
merged one; both are several standard errors wide.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respeval.functions.numbers import round_binary
from respeval.operators.quality import cell, is_null
from respeval.operators.reports import SUCCESS_ON_FIVE, SUCCESS_ON_ONE, with_insights

# Sizes of the sketches: about 20 KB for the values of a column, and 4 KB for what is distinct.
KLL_K = 800
HLL_LG_K = 12

_NUMBERS = ("mean", "squares", "min", "max", "good_on_one", "good_on_five", "values")


def rank_error(k: int = KLL_K) -> float:
    """How far the rank of a quantile is off at most, as a share of the values.

    Twice what KLL sketches keep 99 % of the time, which is five standard errors.
    """
    return 2 * 2.296 / k**0.9021


def distinct_error(lg_k: int = HLL_LG_K) -> float:
    """How far a distinct count is off at most, as a share of itself: four standard errors."""
    return 4 * 1.04 / 2 ** (lg_k / 2)


def summarize(df: DataFrame, by: Sequence[str] = (), columns: Sequence[str] | None = None) -> DataFrame:
    """One row per group of ``by`` and column, to be stored and merged.

    Numbers have mean, squares, min, max and a sketch of their values, and how many count as a success on
    either scale. NaN is missing. A table without rows has no groups, and no summary unless ``by`` is empty.
    """
    names = [n for n in (columns or df.columns) if n not in by]
    numeric = {n for n in names if isinstance(df.schema[n].dataType, T.NumericType)}
    aggregates = [F.count(F.lit(1)).alias("__rows")]
    for i, n in enumerate(names):
        number, key = cell(df, n)
        either = F.coalesce(key, number.cast("string"))
        parts = {"nulls": F.count_if(is_null(df, n)), "distinct": F.hll_sketch_agg(either, HLL_LG_K)}
        if n in numeric:
            c = df[n].cast("double")
            known = F.when(~F.isnan(c), c)
            parts |= {
                "mean": F.avg(known),
                "squares": F.var_pop(known) * F.count(known),
                "min": F.min(known),
                "max": F.max(known),
                "good_on_one": F.count_if(known >= SUCCESS_ON_ONE),
                "good_on_five": F.count_if(known >= SUCCESS_ON_FIVE),
                "values": F.kll_sketch_agg_double(known, KLL_K),
            }
        aggregates += [c.alias(f"__{part}_{i}") for part, c in parts.items()]
    kinds = {"good_on_one": "bigint", "good_on_five": "bigint", "values": "binary"}

    def of(i: int, part: str) -> Column:
        have = names[i] in numeric
        return (F.col(f"__{part}_{i}") if have else F.lit(None)).cast(kinds.get(part, "double")).alias(part)

    rows = [
        F.struct(
            F.lit(i).alias("place"),
            F.lit(n).alias("column"),
            F.lit(df.schema[n].dataType.simpleString()).alias("dtype"),
            F.col("__rows").alias("rows"),
            F.col(f"__nulls_{i}").alias("nulls"),
            F.col(f"__distinct_{i}").alias("distinct"),
            *[of(i, part) for part in _NUMBERS],
        )
        for i, n in enumerate(names)
    ]
    return df.groupBy(*by).agg(*aggregates).select(*by, F.inline(F.array(*rows)))


def _known(prefix: str = "") -> Column:
    return F.col(f"{prefix}rows") - F.col(f"{prefix}nulls")


def merge_summaries(summaries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Summaries of the union of the groups, per ``by`` (some of the columns they were made by).

    The mean of all is found first, so squares are added up about it and lose no digits.
    """
    keys = [*by, "place", "column", "dtype"]
    n = F.when(F.col("mean").isNotNull(), _known())
    means = summaries.groupBy(*keys).agg((F.sum(n * F.col("mean")) / F.sum(n)).alias("__mean"))
    means = means.select(*[F.col(k).alias(f"__{k}") for k in keys], "__mean")
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"__{k}"))
    about = F.col("squares") + n * F.pow(F.col("mean") - F.col("__mean"), F.lit(2))
    # A sketch without values cannot be merged.
    values = F.when(F.col("mean").isNotNull(), F.col("values"))
    return (
        summaries.join(means, same)
        .groupBy(*keys)
        .agg(
            F.sum("rows").alias("rows"),
            F.sum("nulls").alias("nulls"),
            F.hll_union_agg("distinct").alias("distinct"),
            F.first("__mean").alias("mean"),
            F.sum(about).alias("squares"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.sum("good_on_one").alias("good_on_one"),
            F.sum("good_on_five").alias("good_on_five"),
            F.kll_merge_agg_double(values, KLL_K).alias("values"),
        )
    )


def quantile(share: float) -> Column:
    """A quantile of a summary's values; null without values."""
    return F.when(F.col("mean").isNotNull(), F.kll_sketch_get_quantile_double(F.col("values"), F.lit(float(share))))


def summary_report(summaries: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per column what ``quality_report_columns`` reports, with median and distinct count from sketches."""
    return summaries.orderBy(*by, "place").select(
        *by,
        "column",
        "dtype",
        F.col("nulls").alias("null_count"),
        round_binary(F.try_divide(F.col("nulls"), F.col("rows")) * 100, 2).alias("null_percentage"),
        F.hll_sketch_estimate("distinct").alias("unique_values"),
        "mean",
        quantile(0.5).alias("median"),
        F.sqrt(F.try_divide(F.col("squares"), F.nullif(_known() - 1, F.lit(0)))).alias("std"),
        "min",
        "max",
    )


def summary_of_scores(summaries: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """What ``executive_summary`` says of the scores in column ``name``, from its summaries.

    ``aggregated_score`` is on 0-1, ``overall_score`` on 0-5, any other column on 0-1 if its mean is 1 or less.
    """
    scores = summaries.filter(F.col("column") == name)
    std = F.sqrt(F.try_divide(F.col("squares"), F.nullif(_known() - 1, F.lit(0))))
    stats = scores.select(
        *by,
        F.col("rows").alias("total_evaluations"),
        "mean",
        quantile(0.5).alias("middle"),
        std.alias("std"),
        "good_on_one",
        "good_on_five",
    )
    return with_insights(stats, name, by)
