"""Requests in the trailing minute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECOND = 1_000_000


def _micros(df: DataFrame, time: str) -> Column:
    """Microseconds since 1970; of a timestamp without zone, whatever the session's zone."""
    if isinstance(df.schema[time].dataType, T.TimestampNTZType):
        epoch = F.lit("1970-01-01").cast("timestamp_ntz")
        return F.timestamp_diff("MICROSECOND", epoch, F.col(time))
    return F.unix_micros(F.col(time).cast("timestamp"))


def request_rate(
    requests: DataFrame, time: str, keys: Sequence[str] = (), calls_per_minute: int = 60
) -> DataFrame:
    """Per key and instant at which requests came in: calls of the last 60 seconds, and load.

    Requests of one instant are counted first, then those of each second. A trailing minute is 59
    whole seconds, which a window over the seconds of two minutes adds up, its own second up to the
    instant, and what of the second 60 before comes after the instant's place in it. So no window
    task holds more than the instants of two seconds of a key, or the seconds of two minutes.
    """
    if calls_per_minute <= 0:
        raise ValueError("calls_per_minute must be positive")
    instants = (
        requests.filter(F.col(time).isNotNull())
        .groupBy(*keys, F.col(time))
        .agg(F.count(F.lit(1)).alias("requests"))
        .withColumn("__at", _micros(requests, time))
    )
    place = F.pmod(F.col("__at"), F.lit(SECOND))
    instants = instants.select(
        *keys, time, "requests", ((F.col("__at") - place) / SECOND).cast("bigint").alias("__second"),
        place.alias("__place"),
    )
    nothing = F.lit(0).cast("bigint")
    time_type = instants.schema[time].dataType

    seconds = instants.groupBy(*keys, "__second").agg(F.sum("requests").alias("n"))
    own = F.floor(F.col("__second") / 60)
    seconds = seconds.withColumn("__own", own).withColumn(
        "__minute", F.explode(F.array(F.col("__own"), F.col("__own") + 1))
    )
    whole = Window.partitionBy(*keys, "__minute").orderBy("__second").rangeBetween(-59, -1)
    seconds = seconds.withColumn("__whole", F.coalesce(F.sum("n").over(whole), nothing))
    seconds = seconds.filter(F.col("__own") == F.col("__minute")).select(
        *keys, F.lit(None).cast(time_type).alias(time), nothing.alias("requests"), "__second",
        F.lit(-1).cast("bigint").alias("__place"), nothing.alias("__old"), "__whole",
    )

    # Each instant counts in its own second, and in the one a minute later as one that drops out.
    both = F.array(
        F.struct("__second", F.col(time), "requests", nothing.alias("__old")),
        F.struct(
            (F.col("__second") + 60).alias("__second"),
            F.lit(None).cast(time_type).alias(time),
            nothing.alias("requests"),
            F.col("requests").alias("__old"),
        ),
    )
    rows = instants.select(*keys, "__place", F.inline(both)).withColumn("__whole", nothing)
    rows = rows.unionByName(seconds)
    second = Window.partitionBy(*keys, "__second")
    upto = second.orderBy("__place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    calls = (
        F.sum("requests").over(upto)
        + F.sum("__old").over(second)
        - F.sum("__old").over(upto)
        + F.sum("__whole").over(second)
    )
    return (
        rows.withColumn("calls_last_minute", calls)
        .filter(F.col(time).isNotNull())
        .select(
            *keys,
            time,
            "requests",
            "calls_last_minute",
            F.lit(calls_per_minute).alias("calls_per_minute_limit"),
            (F.col("calls_last_minute") / F.lit(float(calls_per_minute)) * 100).alias(
                "utilization_percent"
            ),
        )
    )


def with_request_rate(
    requests: DataFrame, time: str, keys: Sequence[str] = (), calls_per_minute: int = 60
) -> DataFrame:
    """Each request with its ``calls_last_minute`` and ``utilization_percent``.

    The rates of ``request_rate``, one row per key and instant, are joined back to the rows. A
    request without a time has no rate.
    """
    by = [*keys, time]
    rate = request_rate(requests, time, keys, calls_per_minute).select(
        *[F.col(c).alias(f"__{c}") for c in by], "calls_last_minute", "utilization_percent"
    )
    same = F.lit(True)
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    joined = requests.join(rate, same, "left")
    return joined.drop(*[f"__{c}" for c in by])
