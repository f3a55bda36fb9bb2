"""Structured Streaming forms of the operators.

Every sink here writes a micro-batch under its batch id, so a batch that is run again after a
failure replaces its first attempt and nothing is lost or doubled.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from respeval.functions.numbers import round_binary
from respeval.operators.quality import repaired_scores, row_digest, trimmed_strings
from respeval.operators.scoring import Rubric, score_responses

Sink = Callable[[DataFrame, int], None]


def persist_batches(path: str) -> Sink:
    """A ``foreachBatch`` function that stores each micro-batch as ``path/batch_id=<id>``."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return write


def run_available(
    stream: DataFrame, sink: Sink, checkpoint: str, then: Sink | None = None
) -> StreamingQuery:
    """Run a stream over all input there is, batch by batch, and wait for the end.

    ``then`` is called on each batch after it was stored.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        sink(batch, batch_id)
        if then is not None:
            then(batch, batch_id)

    query = (
        stream.writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def _with_batch_id(like: DataFrame) -> T.StructType:
    return T.StructType([*like.schema.fields, T.StructField("batch_id", T.LongType())])


def read_persisted(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """All batches stored under ``path`` so far, with the columns of ``like``."""
    return spark.read.schema(_with_batch_id(like)).parquet(path).select(*like.columns)


def score_stream(stream: DataFrame, rubric: Rubric | None = None) -> DataFrame:
    """Scoring keeps no state, so a stream is scored like a table."""
    return score_responses(stream, rubric)


def rate_stream(
    requests: DataFrame,
    time: str,
    keys: Sequence[str] = (),
    calls_per_minute: int = 60,
    late: str = "2 minutes",
    slide: str = "10 seconds",
) -> DataFrame:
    """Requests per sliding minute; a window is emitted once it can get no more late rows."""
    window = F.window("__ts", "1 minute", slide)
    return (
        requests.withColumn("__ts", F.col(time).cast("timestamp"))
        .withWatermark("__ts", late)
        .groupBy(*keys, window)
        .agg(F.count(F.lit(1)).alias("calls"))
        .select(
            *keys,
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "calls",
            (F.col("calls") / F.lit(float(calls_per_minute)) * 100).alias("utilization_percent"),
        )
    )


def clean_stream(
    results: DataFrame, time: str, late: str = "1 day", ignore: Sequence[str] | None = None
) -> DataFrame:
    """``clean_results`` of a stream: copies that arrive within ``late`` of the first are dropped, in any batch.

    State holds one digest per row of that time, spread by digest, and no row. ``time`` is when a row arrived:
    it and what else is in ``ignore`` (by default only ``time``) does not tell rows apart, and the first row's stays.
    Rows that arrive behind the watermark, which begins at 1970, are dropped.
    """
    left_out = set([time] if ignore is None else ignore)
    rows = trimmed_strings(results)
    digest = row_digest(rows, [c for c in rows.columns if c not in left_out])
    # The watermark is on a column of its own, so that a time given as text is cleaned like any other.
    marked = rows.withColumns({"__digest": digest, "__ts": F.col(time).cast("timestamp")})
    first = marked.withWatermark("__ts", late).dropDuplicatesWithinWatermark(["__digest"])
    return repaired_scores(first.drop("__digest", "__ts"))


def repeated_id_stream(
    results: DataFrame, time: str, key: str = "prompt_id", period: str = "1 day", late: str = "1 hour"
) -> DataFrame:
    """Ids that occur more than once in a period, with their count so far, for update mode.

    State holds one row per id of the periods that are not closed yet, combined before it is reached.
    """
    window = F.window("__ts", period)
    return (
        results.withColumn("__ts", F.col(time).cast("timestamp"))
        .withWatermark("__ts", late)
        .groupBy(window, F.col(key))
        .agg(F.count(F.lit(1)).alias("n"))
        .filter("n > 1")
        .select(key, F.col("window.start").alias("period_start"), "n")
    )


def run_updates(updates: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run an aggregated stream in update mode; each batch stores the rows that it changed."""
    query = (
        updates.writeStream.outputMode("update")
        .foreachBatch(persist_batches(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def usage_stream(usage: DataFrame) -> DataFrame:
    """Totals per model so far, for update or complete mode; the state is one row per model."""
    return usage.groupBy("model").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"),
        F.sum(round_binary(F.col("cost"), 6)).alias("cost"),
    )


def run_totals(totals: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Run an aggregated stream over all input there is; each batch stores all totals so far."""
    query = (
        totals.writeStream.outputMode("complete")
        .foreachBatch(persist_batches(path))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def read_latest(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The totals of the last batch stored under ``path``."""
    stored = spark.read.schema(_with_batch_id(like)).parquet(path)
    last = stored.agg(F.max("batch_id")).scalar()
    return stored.filter(F.col("batch_id") == last).select(*like.columns)
