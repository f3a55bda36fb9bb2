"""Validation, cleaning and profiling of result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respeval.functions.numbers import round_binary
from respeval.functions.scores import GRADES, expected_grade
from respeval.functions.text import strip
from respeval.operators.running import medians_of_slices, slice_table
from respeval.sources.storage import broadcast_if_small, write_and_read

# The columns each kind of table must have, and the range of scores.
REQUIRED_COLUMNS = {
    "raw_results": ("prompt_id", "prompt", "response", "timestamp"),
    "scored_results": ("prompt_id", "response", "overall_score", "grade"),
}
LOWEST_SCORE, HIGHEST_SCORE = 0.0, 5.0

# Strings up to this length are grouped as they are, longer ones by their digest.
_PLAIN_KEY = 64


def _is_string(kind: T.DataType) -> bool:
    return isinstance(kind, T.StringType)


def _is_float(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FloatType, T.DoubleType))


def grouping_key(df: DataFrame, name: str) -> Column:
    """A column to group equal values by: long strings shrink to a SHA-256 digest first."""
    c = df[name]
    if not _is_string(df.schema[name].dataType):
        return c
    short = F.length(c) <= _PLAIN_KEY
    return F.when(short, F.concat(F.lit("="), c)).otherwise(F.sha2(c, 256))


def duplicated_keys(df: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Each value of ``key`` that occurs more than once, with its count. Nulls equal each other."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def duplicate_ids(df: DataFrame, key: str = "prompt_id") -> DataFrame:
    """All rows whose ``key`` occurs more than once.

    Counts per key are combined before the shuffle and joined back as one row per key. As long as
    few keys repeat, only keys are shuffled, never the rows themselves.
    """
    repeated = broadcast_if_small(duplicated_keys(df, key).select(F.col(key).alias("__key")))
    return df.join(repeated, df[key].eqNullSafe(F.col("__key")), "left_semi")


def is_null(df: DataFrame, name: str) -> Column:
    null = df[name].isNull()
    return null | F.isnan(df[name]) if _is_float(df.schema[name].dataType) else null


def _score_columns(df: DataFrame) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if f.name.startswith("score_") and isinstance(f.dataType, T.NumericType)
    ]


def bad_timestamp(df: DataFrame, name: str = "timestamp") -> Column:
    """Text that is no timestamp; a typed timestamp column is always good."""
    if not _is_string(df.schema[name].dataType):
        return F.lit(False)
    return df[name].isNotNull() & F.try_to_timestamp(df[name]).isNull()


def invalid_grade(grade: Column) -> Column:
    return ~F.coalesce(grade.isin(*GRADES), F.lit(False))


def inconsistent_grade(grade: Column, score: Column) -> Column:
    return ~grade.eqNullSafe(expected_grade(score))


def grade_consistency(df: DataFrame) -> DataFrame:
    """Rows whose grade is not the one their score calls for, with the expected one."""
    return df.withColumn("expected_grade", expected_grade(F.col("overall_score"))).filter(
        ~F.col("grade").eqNullSafe(F.col("expected_grade"))
    )


def invalid_grades(df: DataFrame) -> DataFrame:
    """Each grade value that is not allowed, with its number of rows."""
    return df.filter(invalid_grade(F.col("grade"))).groupBy("grade").agg(
        F.count(F.lit(1)).alias("n")
    )


def validate_table(df: DataFrame, kind: str = "raw_results") -> DataFrame:
    """Issues of a table as rows (issue, column, rows, percentage); no row means valid.

    All row counts come from one aggregate without a shuffle of rows; only the duplicate ids need
    a grouping. ``duplicated_keys`` and ``invalid_grades`` list the values behind an issue.
    """
    required = REQUIRED_COLUMNS.get(kind, ())
    # Issue -> (column, aggregate giving the number of rows concerned).
    checks: list[tuple[str, str | None, Column]] = [
        ("missing_column", name, F.count(F.lit(1))) for name in required if name not in df.columns
    ]
    if kind == "scored_results":
        for name in _score_columns(df):
            c = df[name].cast("double")
            # NaN compares above every number but is a missing value.
            outside = ((c < LOWEST_SCORE) | (c > HIGHEST_SCORE)) & ~F.isnan(c)
            checks.append(("score_out_of_range", name, F.count_if(outside)))
            known = F.when(~F.isnan(c), c)
            checks.append(
                (
                    "single_value",
                    name,
                    F.when(F.min(known) == F.max(known), F.count(known)).otherwise(F.lit(0)),
                )
            )
        if "grade" in df.columns:
            checks.append(("invalid_grade", "grade", F.count_if(invalid_grade(df["grade"]))))
            if "overall_score" in df.columns:
                wrong = inconsistent_grade(df["grade"], df["overall_score"])
                checks.append(("inconsistent_grade", "grade", F.count_if(wrong)))
    for name in required:
        if name in df.columns:
            checks.append(("null_values", name, F.count_if(is_null(df, name))))
    if "timestamp" in df.columns:
        checks.append(("invalid_timestamp", "timestamp", F.count_if(bad_timestamp(df))))

    counts = df.agg(
        F.count(F.lit(1)).alias("__total"),
        *[c.alias(f"__{i}") for i, (_, _, c) in enumerate(checks)],
    )
    total = F.col("__total")
    found = [
        F.struct(
            F.lit(issue).alias("issue"),
            F.lit(name).cast("string").alias("column"),
            F.col(f"__{i}").cast("bigint").alias("rows"),
            total.alias("total"),
        )
        for i, (issue, name, _) in enumerate(checks)
    ]
    empty = F.struct(
        F.lit("empty_table").alias("issue"),
        F.lit(None).cast("string").alias("column"),
        F.lit(0).cast("bigint").alias("rows"),
        total.alias("total"),
    )
    # An empty table has no other issue.
    issues = counts.select(
        F.inline(F.when(total == 0, F.array(empty)).otherwise(F.array(*found, empty)))
    ).filter((F.col("rows") > 0) | (F.col("total") == 0))
    if "prompt_id" in df.columns:
        repeated = duplicated_keys(df).agg(F.sum("n").alias("rows")).select(
            F.lit("duplicate_ids").alias("issue"),
            F.lit("prompt_id").alias("column"),
            "rows",
            F.lit(None).cast("bigint").alias("total"),
        )
        issues = issues.unionByName(repeated.filter(F.col("rows") > 0))
    share = F.when(F.col("issue") == "null_values", F.col("rows") / F.col("total") * 100)
    return issues.select("issue", "column", "rows", share.alias("percentage"))


def _exact(c: Column, kind: T.DataType) -> Column:
    """The value with its timestamps, also nested ones, in full; JSON would cut them to milliseconds."""
    if not _has_timestamp(kind):
        return c
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _exact(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform(
            F.map_entries(c),
            lambda e: F.struct(
                _exact(e["key"], kind.keyType).alias("key"), _exact(e["value"], kind.valueType).alias("value")
            ),
        )
    if isinstance(kind, T.StructType):
        fields = [_exact(c.getField(f.name), f.dataType).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c.cast("string")


def _has_timestamp(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _has_timestamp(kind.elementType)
    if isinstance(kind, T.MapType):
        return _has_timestamp(kind.keyType) or _has_timestamp(kind.valueType)
    if isinstance(kind, T.StructType):
        return any(_has_timestamp(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType))


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """SHA-256 of a row's values, the same for equal rows and for no others."""

    def plain(f: T.StructField) -> Column:
        # Negative zero equals zero, as in grouping.
        is_float = isinstance(f.dataType, (T.FloatType, T.DoubleType))
        return (F.col(f.name) + F.lit(0.0) if is_float else _exact(F.col(f.name), f.dataType)).alias(f.name)

    fields = [df.schema[c] for c in (df.columns if columns is None else columns)]
    return F.sha2(F.to_json(F.struct(*[plain(f) for f in fields])), 256)


def _drop_duplicate_rows(df: DataFrame) -> DataFrame:
    if not df.columns:
        return df
    marked = df.withColumn("__digest", row_digest(df))
    repeated = marked.groupBy("__digest").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1")
    repeated = broadcast_if_small(repeated.select("__digest"))
    single = marked.join(repeated, "__digest", "left_anti")
    again = marked.join(repeated, "__digest", "left_semi").dropDuplicates(["__digest"])
    return single.unionByName(again).drop("__digest")


def trimmed_strings(df: DataFrame) -> DataFrame:
    return df.select(
        *[
            strip(df[f.name]).alias(f.name) if _is_string(f.dataType) else df[f.name]
            for f in df.schema.fields
        ]
    )


def repaired_scores(df: DataFrame) -> DataFrame:
    """Scores clipped to their range, and grades that are not allowed replaced by the lowest."""

    def repaired(f: T.StructField) -> Column:
        c = F.col(f.name)
        if f.name == "grade":
            upper = F.upper(c.cast("string"))
            return F.when(upper.isin(*GRADES), upper).otherwise("F").alias(f.name)
        if f.name == "overall_score" or f.name.startswith("score_"):
            if not isinstance(f.dataType, T.NumericType):
                return c
            clipped = F.greatest(F.lit(LOWEST_SCORE), F.least(F.lit(HIGHEST_SCORE), c))
            known = c.isNotNull() & ~F.isnan(c.cast("double"))
            return F.when(known, clipped.cast(f.dataType)).otherwise(c).alias(f.name)
        return c

    return df.select(*[repaired(f) for f in df.schema.fields])


def clean_results(df: DataFrame) -> DataFrame:
    """Trim strings, drop duplicate rows, clip scores, repair grades, in this order.

    Clipping and repair come after the duplicates are dropped, so rows that differ only in an
    out-of-range score or a bad grade both stay. Only digests are shuffled, and the rows whose digest
    occurs more than once; these digests are counted and stored when this is called.
    """
    return repaired_scores(_drop_duplicate_rows(trimmed_strings(df)))


def quality_report_table(df: DataFrame) -> DataFrame:
    """One row: rows, columns, and rows that repeat an earlier one."""
    groups = df.groupBy(*[grouping_key(df, c).alias(c) for c in df.columns]).agg(
        F.count(F.lit(1)).alias("n")
    )
    return groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total_rows"),
        F.lit(len(df.columns)).cast("bigint").alias("total_columns"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicate_rows"),
    )


# Whole numbers up to this size are exact as doubles.
_EXACT_WHOLE = 2**53


def cell(df: DataFrame, name: str) -> tuple[Column, Column]:
    """A value as (number, short string) that is equal for equal values and null if missing.

    Numbers that a double holds exactly need no string.
    """
    kind, c = df.schema[name].dataType, df[name]
    no_number, no_key = F.lit(None).cast("double"), F.lit(None).cast("string")
    if _is_string(kind):
        return no_number, grouping_key(df, name)
    if _is_float(kind):
        # Adding zero turns -0.0 into 0.0.
        return F.when(~F.isnan(c), c.cast("double") + F.lit(0.0)), no_key
    if isinstance(kind, (T.LongType, T.DecimalType)):
        exact = F.lit(False) if isinstance(kind, T.DecimalType) else F.abs(c) <= _EXACT_WHOLE
        return c.cast("double"), F.when(~exact, c.cast("string"))
    if isinstance(kind, T.NumericType):
        return c.cast("double"), no_key
    if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
        return no_number, F.when(c.isNotNull(), F.sha2(F.to_json(F.struct(_exact(c, kind).alias("c"))), 256))
    return no_number, c.cast("string")


def quality_report_columns(
    df: DataFrame, approximate: bool = False, columns: Sequence[str] | None = None
) -> DataFrame:
    """Per column: type, nulls, distinct values, and for numbers mean, median, std, min, max.

    Counts and moments come from one aggregate over the table. Distinct values and medians need
    the values themselves: they are counted per (column, value) before they move, once for both.
    ``approximate=True`` takes sketches for both instead, which leaves a single pass.
    """
    names = list(columns or df.columns)
    kinds = {n: df.schema[n].dataType for n in names}
    numeric = [n for n in names if isinstance(kinds[n], T.NumericType)]

    def known(name: str) -> Column:
        c = df[name].cast("double")
        return F.when(~F.isnan(c), c)

    aggregates = [F.count(F.lit(1)).alias("__total")]
    for i, n in enumerate(names):
        aggregates.append(F.count_if(is_null(df, n)).alias(f"__nulls_{i}"))
        if n in numeric:
            for label, f in (
                ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)
            ):
                aggregates.append(f(known(n)).alias(f"__{label}_{i}"))
            if approximate:
                aggregates.append(F.percentile_approx(known(n), 0.5).alias(f"__median_{i}"))
        if approximate:
            either = F.coalesce(*[part.cast("string") for part in reversed(cell(df, n))])
            aggregates.append(F.approx_count_distinct(either).alias(f"__unique_{i}"))
    wide = df.agg(*aggregates)

    def stat(i: int, label: str, available: bool) -> Column:
        return (F.col(f"__{label}_{i}") if available else F.lit(None)).cast("double").alias(label)

    rows = []
    for i, n in enumerate(names):
        is_number = n in numeric
        nulls = F.col(f"__nulls_{i}")
        rows.append(
            F.struct(
                F.lit(i).alias("place"),
                F.lit(n).alias("column"),
                F.lit(kinds[n].simpleString()).alias("dtype"),
                nulls.cast("bigint").alias("null_count"),
                (F.try_divide(nulls, F.col("__total")) * 100).alias("null_percentage"),
                (F.col(f"__unique_{i}") if approximate else F.lit(None))
                .cast("bigint")
                .alias("unique_values"),
                stat(i, "mean", is_number),
                stat(i, "median", is_number and approximate),
                stat(i, "std", is_number),
                stat(i, "min", is_number),
                stat(i, "max", is_number),
            )
        )
    report = wide.select(F.inline(F.array(*rows))).withColumn(
        "null_percentage", round_binary(F.col("null_percentage"), 2)
    )
    if approximate:
        return report.drop("place")

    cells = []
    for i, n in enumerate(names):
        number, key = cell(df, n)
        cells.append(
            F.struct(F.lit(i).alias("column"), number.alias("value"), key.alias("key"))
        )
    counts = (
        df.select(F.explode(F.array(*cells)).alias("cell"))
        .select("cell.*")
        .filter(F.col("value").isNotNull() | F.col("key").isNotNull())
        .groupBy("column", "value", "key")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counts = slice_table(write_and_read(counts, "counts"), ["column", "value"])
    distinct = counts.groupBy(F.col("column").alias("place")).agg(
        F.count(F.lit(1)).alias("__unique")
    )
    medians = medians_of_slices(counts.drop("key")).select(
        F.col("column").alias("place"), F.col("median").alias("__median")
    )
    # Both lookups have one row per column of the table.
    report = (
        report.join(F.broadcast(distinct), "place", "left")
        .join(F.broadcast(medians), "place", "left")
        .withColumn("unique_values", F.coalesce("__unique", F.lit(0)).cast("bigint"))
        .withColumn("median", F.col("__median"))
    )
    return report.select(
        "column", "dtype", "null_count", "null_percentage", "unique_values",
        "mean", "median", "std", "min", "max",
    )
