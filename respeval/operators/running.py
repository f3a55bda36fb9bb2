"""Running totals over a whole table, the budget check, and exact medians."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from respeval.sources.storage import write_and_read

# A warning is due once less than this share of the limit is left; the messages.
WARNING_SHARE = 0.2
EXCEEDED = "Budget exceeded: $%.4f spent, $%.4f available"
NEARLY_SPENT = "Budget warning: $%.4f remaining (80%% spent)"


SLICE = "__slice"
# Slices: so many, and one more for every so many rows, up to a bound on the size of the expression.
SLICES = 16
ROWS_PER_SLICE = 1_000_000
MOST_SLICES = 2048
SAMPLED_PER_SLICE = 50


def slice_table(df: DataFrame, keys: Sequence[str], slices: int | None = None) -> DataFrame:
    """Number ranges of ``keys`` with about equally many rows, in order.

    Reads the keys twice when called, to count and to sample them. The bounds of the slices are
    literals, so a row's slice depends on the row alone, wherever and however often it is computed.
    """
    narrow = df.select(*keys)
    rows = narrow.count()
    slices = slices or min(MOST_SLICES, SLICES + rows // ROWS_PER_SLICE)
    share = min(1.0, SAMPLED_PER_SLICE * slices / max(rows, 1))
    sample = narrow.sample(share, seed=1).orderBy(*keys).collect()
    picked = [sample[i * len(sample) // slices] for i in range(1, slices)] if sample else []
    bounds = list(dict.fromkeys(tuple(r) for r in picked))
    types = [df.schema[k].dataType for k in keys]
    here = F.struct(*[F.col(k) for k in keys])

    def number(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        values = zip(keys, bounds[middle], types, strict=True)
        bound = F.struct(*[F.lit(v).cast(t).alias(k) for k, v, t in values])
        return F.when(here >= bound, number(middle + 1, high)).otherwise(number(low, middle))

    return df.withColumn(SLICE, number(0, len(bounds)))


def running_sum(
    df: DataFrame,
    order_by: Sequence[str],
    sums: dict[str, str],
    partition_by: Sequence[str] = (),
    slices: int | None = None,
) -> DataFrame:
    """Add, for each ``output: input`` of ``sums``, the total of the input so far.

    A null input adds nothing; the total is null until a value was seen. Rows are shuffled once.
    ``order_by`` must tell any two rows of a partition apart. All columns of the table are moved,
    so select those you need first.
    """
    if not order_by:
        raise ValueError("a running sum needs an order")
    sliced = slice_table(df, [*partition_by, *order_by], slices)
    return running_sum_of_slices(sliced, order_by, sums, partition_by)


def plus(a: Column, b: Column) -> Column:
    """The sum of two totals; null, as no value was seen, only if both are."""
    return F.when(a.isNotNull() & b.isNotNull(), a + b).otherwise(F.coalesce(a, b))


def running_sum_of_slices(
    sliced: DataFrame, order_by: Sequence[str], sums: dict[str, str], partition_by: Sequence[str]
) -> DataFrame:
    """``running_sum`` of a table from ``slice_table`` over (partition, order).

    One partition holding most of the table, or the whole table as one partition, is still spread
    over all tasks: each slice is summed on its own and shifted by what earlier slices of the same
    partition add up to. Only a slice's first partition can have started in an earlier slice, so
    the shifts are at most one row per slice, however large the table.
    """
    grain = [*partition_by, SLICE]
    totals = sliced.groupBy(*grain).agg(
        *[F.sum(source).alias(f"__{out}") for out, source in sums.items()]
    )
    earlier = (
        Window.partitionBy(*(partition_by or [F.lit(0)]))
        .orderBy(SLICE)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    # Own names on this side: both sides of the join come from the same table.
    shifts = (
        totals.withColumn("__before", F.count(F.lit(1)).over(earlier))
        .select(
            *[F.col(g).alias(f"__of_{g}") for g in grain],
            "__before",
            *[F.sum(f"__{out}").over(earlier).alias(f"__shift_{out}") for out in sums],
        )
        .filter("__before > 0")
    )
    so_far = Window.partitionBy(*grain).orderBy(*order_by).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    local = sliced.select(
        "*", *[F.sum(source).over(so_far).alias(f"__l_{out}") for out, source in sums.items()]
    )
    same_slice = F.lit(True)
    for g in grain:
        same_slice = same_slice & F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    joined = local.join(F.broadcast(shifts), same_slice, "left")
    return joined.select(
        *[c for c in sliced.columns if c not in sums and c != SLICE],
        *[plus(F.col(f"__l_{out}"), F.col(f"__shift_{out}")).alias(out) for out in sums],
    )


def cumulative_cost(
    usage: DataFrame, order_by: Sequence[str], partition_by: Sequence[str] = ()
) -> DataFrame:
    """Add ``cumulative_cost`` and ``cumulative_tokens`` in request order."""
    counted = usage.withColumn("__tokens", F.col("input_tokens") + F.col("output_tokens"))
    sums = {"cumulative_cost": "cost", "cumulative_tokens": "__tokens"}
    return running_sum(counted, order_by, sums, partition_by).drop("__tokens")


def check_limit(limit: float | None) -> None:
    if limit is not None and limit < 0:
        raise ValueError(f"budget limit must not be negative, got {limit}")


def alert_columns(spent: Column, limit: float) -> tuple[Column, Column]:
    """Alert type and message for an amount spent under a limit; null type if all is well."""
    limit_col = F.lit(float(limit))
    left = limit_col - spent
    kind = F.when(left < 0, "error").when(left < limit_col * F.lit(WARNING_SHARE), "warning")
    message = F.when(
        kind == "error",
        F.format_string(EXCEEDED, spent, limit_col),
    ).when(kind == "warning", F.format_string(NEARLY_SPENT, left))
    return kind, message


def budget_status(
    usage: DataFrame,
    limit: float | None,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Running cost with ``remaining``, ``alert`` and ``message`` after each request.

    Without a limit, or with a limit of 0, no request is checked and the three are null.
    """
    check_limit(limit)
    running = cumulative_cost(usage, order_by, partition_by)
    if not limit:
        nothing = F.lit(None)
        return running.select(
            "*",
            nothing.cast("double").alias("remaining"),
            nothing.cast("string").alias("alert"),
            nothing.cast("string").alias("message"),
        )
    kind, message = alert_columns(F.col("cumulative_cost"), limit)
    left = F.lit(float(limit)) - F.col("cumulative_cost")
    return running.select(
        "*", left.alias("remaining"), kind.alias("alert"), message.alias("message")
    )


def budget_alerts(
    usage: DataFrame,
    limit: float | None,
    order_by: Sequence[str],
    partition_by: Sequence[str] = (),
) -> DataFrame:
    return budget_status(usage, limit, order_by, partition_by).filter(F.col("alert").isNotNull())


def exact_medians(values: DataFrame) -> DataFrame:
    """Exact interpolated median per column name of a table (column, value).

    Equal values are counted before anything is ordered, so few distinct values mean little data,
    and many are ordered over all tasks rather than gathered in one.
    """
    counts = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    counts = write_and_read(counts, "counts")
    return medians_of_slices(slice_table(counts, ["column", "value"]))


def medians_of_slices(counts: DataFrame) -> DataFrame:
    """Medians of counted values (column, value, n), sliced over (column, value).

    Nulls and NaN are left out.
    """
    known = counts.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    ranked = running_sum_of_slices(known, ["value"], {"upto": "n"}, ["column"])
    # One row per column name: as short as a table is wide.
    sizes = known.groupBy("column").agg(F.sum("n").alias("size"))
    # Zero-based places of the lower and the upper middle value.
    lower = F.floor((F.col("size") - 1) / 2)
    upper = F.floor(F.col("size") / 2)

    def at(place: Column) -> Column:
        inside = (F.col("upto") - F.col("n") <= place) & (place < F.col("upto"))
        return F.max(F.when(inside, F.col("value")))

    return (
        ranked.join(F.broadcast(sizes), "column")
        .groupBy("column")
        .agg(((at(lower) + at(upper)) / 2).alias("median"))
    )
