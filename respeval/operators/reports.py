"""Report tables: statistics, summaries, defect counts, histograms, the sample of results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respeval.functions.numbers import number_column
from respeval.functions.sanitize import html_escape
from respeval.functions.scores import DEFAULT_WEIGHTS
from respeval.operators.running import medians_of_slices, slice_table
from respeval.operators.scoring import present, prompt_text
from respeval.sources.storage import write_and_read

# The score that counts as a success on each scale, and the insight bands.
SUCCESS_ON_ONE, SUCCESS_ON_FIVE = 0.7, 3.5
INSIGHT_BANDS = (("excellent", 4.5), ("good", 3.5), ("acceptable", 2.5))
LOWEST_BAND = "below_expectations"
HIGH_VARIANCE = 1.0
SAMPLE_ROWS = 100
# So many different values are held by one task.
FEW_VALUES = 100_000
SAMPLE_PROMPT_CHARS = 100


def _known(df: DataFrame, name: str) -> Column:
    value = number_column(df, name)
    return F.when(~F.isnan(value), value)


def _first_present(df: DataFrame, names: Sequence[str]) -> str | None:
    return next((n for n in names if n in df.columns), None)


def report_statistics(df: DataFrame) -> DataFrame:
    """One row: number of rows and mean score per dimension, on 0-5.

    The first candidate column the table has decides, even if it holds nothing readable, in
    which case the mean is 0.
    """
    candidates = {f"mean_{d}": (f"score_{d}", d) for d in DEFAULT_WEIGHTS}
    candidates["mean_overall"] = ("overall_score", "aggregated_score")
    means = []
    for out, names in candidates.items():
        name = _first_present(df, names)
        mean = F.lit(0.0)
        if name is not None:
            on_one = name == "aggregated_score" or name.startswith("score_")
            mean = F.avg(_known(df, name)) * F.lit(5.0 if on_one else 1.0)
        means.append(F.coalesce(mean, F.lit(0.0)).alias(out))
    return df.agg(F.count(F.lit(1)).alias("total_evaluations"), *means)


def insight_band(average: Column) -> Column:
    band = F.when(F.lit(False), LOWEST_BAND)
    for name, floor in INSIGHT_BANDS:
        band = band.when(average >= floor, name)
    return band.otherwise(LOWEST_BAND)


def with_insights(stats: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """The summary of scores in column ``name`` from total_evaluations, mean, middle, std, good_on_one, good_on_five."""
    on_one = {"aggregated_score": F.lit(True), "overall_score": F.lit(False)}.get(
        name, F.coalesce(F.col("mean") <= 1.0, F.lit(False))
    )
    factor = F.when(on_one, 5.0).otherwise(1.0)
    good = F.when(on_one, F.col("good_on_one")).otherwise(F.col("good_on_five"))
    summary = stats.select(
        *by,
        F.col("total_evaluations").cast("bigint").alias("total_evaluations"),
        (F.col("mean") * factor).alias("average_score"),
        (F.col("middle") * factor).alias("median_score"),
        (F.col("std") * factor).alias("std_dev"),
        F.coalesce(F.try_divide(good, "total_evaluations") * 100, F.lit(0.0)).alias("success_rate"),
    )
    return summary.select(
        "*",
        insight_band(F.col("average_score")).alias("insight"),
        F.coalesce(F.col("std_dev") > HIGH_VARIANCE, F.lit(False)).alias("high_variance"),
    )


def executive_summary(df: DataFrame, approximate_median: bool = False) -> DataFrame:
    """One row: count, mean, median, standard deviation, success rate, and what to make of them.

    The success rate is over all rows, also those without a score. Equal scores are counted
    first and the counts stored, so the table is read once; all else comes from the counts. Up to
    ``FEW_VALUES`` different scores one aggregate finds the median as well; beyond, the counts are cut into
    slices. ``approximate_median`` takes a sketch instead and stores nothing.
    """
    name = _first_present(df, ("aggregated_score", "overall_score")) or df.columns[0]
    scores = df.select(_known(df, name).alias("score"))
    if approximate_median:
        score, n = F.col("score"), F.lit(1)
        mean, std = F.avg(score), F.stddev_samp(score)
        middle = F.percentile_approx(score, 0.5)
    else:
        counts = scores.groupBy(F.lit(name).alias("column"), F.col("score").alias("value")).agg(
            F.count(F.lit(1)).alias("n")
        )
        scores = write_and_read(counts, "counts")
        score, n = F.col("value"), F.col("n")
        known = F.sum(F.when(score.isNotNull(), n))
        mean = F.try_divide(F.sum(score * n), known)
        center = scores.agg(mean).scalar()
        squares = F.sum(n * (score - center) * (score - center))
        std = F.sqrt(F.try_divide(squares, F.nullif(known - 1, F.lit(0))))
        few = scores.count() <= FEW_VALUES
        middle = F.percentile(score, 0.5, n) if few else F.lit(None).cast("double")

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    stats = scores.agg(
        rows_where(F.lit(True)).alias("total_evaluations"),
        mean.alias("mean"),
        middle.alias("middle"),
        std.alias("std"),
        rows_where(score >= SUCCESS_ON_ONE).alias("good_on_one"),
        rows_where(score >= SUCCESS_ON_FIVE).alias("good_on_five"),
    )
    if not approximate_median and not few:
        sliced = medians_of_slices(slice_table(scores, ["column", "value"]))
        stats = stats.withColumn("middle", sliced.select("median").scalar())
    return with_insights(stats, name)


def dimension_averages(df: DataFrame) -> DataFrame:
    """Mean of each ``score_*`` column, highest first; columns with unreadable text are left out."""
    names = [
        f.name
        for f in df.schema.fields
        if f.name.startswith("score_") and isinstance(f.dataType, (T.NumericType, T.StringType))
    ]
    if not names:
        schema = "dimension string, average double, display_average double"
        return df.sparkSession.createDataFrame([], schema)
    numbers = {n: number_column(df, n) for n in names}
    wide = df.agg(
        *[F.avg(_known(df, n)).alias(f"__mean_{i}") for i, n in enumerate(names)],
        *[
            F.count_if(df[n].isNotNull() & numbers[n].isNull()).alias(f"__bad_{i}")
            for i, n in enumerate(names)
        ],
    )
    rows = F.array(
        *[
            F.struct(
                F.lit(n.replace("score_", "")).alias("dimension"),
                F.col(f"__mean_{i}").alias("average"),
                F.col(f"__bad_{i}").alias("bad"),
                F.lit(i).alias("place"),
            )
            for i, n in enumerate(names)
        ]
    )
    average = F.col("average")
    return (
        wide.select(F.inline(rows))
        .filter("bad = 0")
        .orderBy(average.desc(), "place")
        .select(
            "dimension",
            "average",
            F.when(average <= 1.0, average * 5.0).otherwise(average).alias("display_average"),
        )
    )


def defect_summary(df: DataFrame) -> DataFrame:
    """Number of times each code is named in ``defects`` (comma-separated text or an array)."""
    codes = df["defects"]
    if isinstance(df.schema["defects"].dataType, T.StringType):
        codes = F.split(codes, ",")
    return (
        df.select(F.explode(codes).alias("defect"))
        .select(F.trim("defect").alias("defect"))
        .filter("defect <> ''")
        .groupBy("defect")
        .agg(F.count(F.lit(1)).alias("count"))
    )


def run_summary(df: DataFrame) -> DataFrame:
    """One row: rows, mean score on 0-5, success rate, tokens and cost of a scored, priced table."""
    name = _first_present(df, ("overall_score", "aggregated_score"))
    rows = F.count(F.lit(1))
    mean, success = F.lit(None).cast("double"), F.lit(None).cast("double")
    if name is not None:
        score = _known(df, name)
        on_five = name == "overall_score"
        mean = F.avg(score) * F.lit(1.0 if on_five else 5.0)
        floor = SUCCESS_ON_FIVE if on_five else SUCCESS_ON_ONE
        success = F.coalesce(F.try_divide(F.count_if(score >= floor), rows) * 100, F.lit(0.0))
    tokens, cost = F.lit(0), F.lit(0.0)
    if {"input_tokens", "output_tokens"} <= set(df.columns):
        tokens = F.coalesce(F.sum(F.col("input_tokens") + F.col("output_tokens")), F.lit(0))
    if "cost" in df.columns:
        cost = F.coalesce(F.sum("cost"), F.lit(0.0))
    return df.agg(
        rows.alias("total_evaluations"),
        mean.alias("average_score"),
        success.alias("success_rate"),
        tokens.cast("bigint").alias("total_tokens"),
        cost.alias("total_cost"),
    )


def execution_summary(df: DataFrame) -> DataFrame:
    """One row: requests, successes, failures, success rate. A missing status is a failure."""
    total = F.count(F.lit(1))
    success = F.count_if(F.col("status") == "success")
    return df.agg(
        total.alias("total"),
        success.alias("success"),
        (total - success).alias("failed"),
        F.coalesce(F.try_divide(success, total) * 100, F.lit(0.0)).alias("success_rate"),
    )


def histogram(values: DataFrame, bins: int, value: str = "value") -> DataFrame:
    """Equal-width bins over the value range, each closed below, the last closed above too.

    A single value widens the range by a half to both sides; no value gives empty bins over 0-1.
    """
    x = F.col(value)
    counted = values.groupBy(F.when(~F.isnan(x), x).alias("x")).agg(F.count(F.lit(1)).alias("n"))
    # Both uses of the counts read the same columns, so their shuffle is done once and reused.
    seen = F.when(F.col("n") > 0, F.col("x"))
    ends = counted.agg(F.min(seen).alias("lo"), F.max(seen).alias("hi"))
    widened = F.when(F.col("lo") == F.col("hi"), 0.5).otherwise(0.0)
    ends = ends.select(
        F.coalesce(F.col("lo") - widened, F.lit(0.0)).alias("lo"),
        F.coalesce(F.col("hi") + widened, F.lit(1.0)).alias("hi"),
    )
    step = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    edges = [F.col("lo") + F.lit(float(i)) * step for i in range(bins)] + [F.col("hi")]
    # The edges are a scalar subquery, named once so that it is planned once. A value's bin is
    # the number of inner edges at or below it.
    placed = counted.select("x", "n", ends.select(F.array(*edges)).scalar().alias("edges"))
    inner = F.slice("edges", 2, bins - 1)
    bin_of = F.size(F.filter(inner, lambda e: F.col("x") >= e))
    counts = placed.select(
        "edges", "n", F.when(F.col("x").isNotNull(), bin_of).alias("bin")
    ).agg(
        F.first("edges").alias("edges"),
        *[
            F.coalesce(F.sum(F.when(F.col("bin") == i, F.col("n"))), F.lit(0)).alias(f"__{i}")
            for i in range(bins)
        ],
    )
    unit = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    filled = counts.withColumn("edges", F.coalesce("edges", unit))
    rows = [
        F.struct(
            F.lit(i).alias("bin"),
            F.col("edges")[i].alias("low"),
            F.col("edges")[i + 1].alias("high"),
            F.col(f"__{i}").alias("count"),
        )
        for i in range(bins)
    ]
    return filled.select(F.inline(F.array(*rows)))


def accuracy_histogram(df: DataFrame, bins: int = 5) -> DataFrame:
    """Histogram of ``accuracy``; unreadable values fall back to ``score_accuracy`` x 5, then 0."""
    value = F.lit(0.0)
    if "accuracy" in df.columns:
        value = number_column(df, "accuracy")
        if "score_accuracy" in df.columns:
            value = F.coalesce(value, number_column(df, "score_accuracy") * 5.0)
        value = F.coalesce(value, F.lit(0.0))
    return histogram(df.select(value.alias("value")), bins)


def overall_histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    name = _first_present(df, ("overall_score", "aggregated_score"))
    if name is None:
        raise ValueError("no overall_score or aggregated_score column")
    return histogram(df.select(number_column(df, name).alias("value")), bins)


def first_rows(df: DataFrame, order_by: Sequence[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows a sample shows; taken from a raw table, only these need to be scored."""
    return df.orderBy(*order_by).limit(rows)


def report_sample(df: DataFrame, order_by: Sequence[str], rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows of the report, HTML-escaped, in the order given.

    The prompt is cut after escaping, and marked as cut by the length of the raw prompt.
    """
    raw_prompt = prompt_text(df, ("prompt_text", "prompt"))
    score = F.when(F.lit(False), F.lit(0.0))
    for name in ("overall_score", "aggregated_score", "score_overall"):
        if name in df.columns:
            value = number_column(df, name)
            scaled = value if name == "overall_score" else F.when(value <= 1.0, value * 5.0)
            score = score.when(value.isNotNull(), F.coalesce(scaled, value))

    def escaped(name: str) -> Column:
        if name not in df.columns:
            return F.lit("")
        return html_escape(F.coalesce(df[name].cast("string"), F.lit("")))

    cut = F.substring(html_escape(raw_prompt), 1, SAMPLE_PROMPT_CHARS)
    shown = F.when(F.length(raw_prompt) > SAMPLE_PROMPT_CHARS, F.concat(cut, F.lit("...")))
    return (
        first_rows(df, order_by, rows)
        .select(
            *present(df, *order_by),
            escaped("prompt_id").alias("sample_id"),
            F.coalesce(shown, cut).alias("prompt"),
            escaped("model").alias("model"),
            score.otherwise(0.0).alias("score"),
            escaped("defects").alias("defects"),
        )
    )
