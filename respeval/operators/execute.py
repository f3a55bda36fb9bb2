"""Batch runs of user functions, and the record of what failed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from respeval.functions.cost import DEFAULT_MODEL
from respeval.functions.errors import error_severity
from respeval.operators.scoring import prompt_text

RESULT_SCHEMA = (
    "prompt_id string, prompt string, response string, model string, status string, "
    "error string, error_type string"
)

# Without a given concurrency: tasks for each core of the cluster, so that slow prompts even out.
TASKS_PER_CORE = 4


def filter_success(df: DataFrame) -> DataFrame:
    """Rows with status ``success``; a table without the column is kept whole."""
    return df.filter(F.col("status") == "success") if "status" in df.columns else df


def map_chunks(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str
) -> DataFrame:
    """Apply a pandas function chunk by chunk; ``spark.sql.execution.arrow.maxRecordsPerBatch``
    sets the chunk size, so ``fn`` must not depend on which rows share a chunk."""

    def run(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for chunk in chunks:
            yield fn(chunk)

    return df.mapInPandas(run, schema)


def asked_prompts(prompts: DataFrame) -> DataFrame:
    """prompt_id and prompt, as they are asked."""
    if not {"prompt", "text"} & set(prompts.columns):
        raise ValueError("prompts need a 'prompt' or a 'text' column")
    names = [n for n in ("id", "prompt_id") if n in prompts.columns]
    ids = [F.nullif(F.col(n).cast("string"), F.lit("")) for n in names]
    return prompts.select(
        F.coalesce(*ids, F.lit("unknown")).alias("prompt_id"),
        prompt_text(prompts, ("prompt", "text")).alias("prompt"),
    )


def execute_prompts(
    prompts: DataFrame,
    fn: Callable[[str], str],
    model: str = DEFAULT_MODEL,
    concurrency: int | None = None,
) -> DataFrame:
    """Run ``fn`` on every prompt; an exception makes an error row, never a failed job.

    So does an answer that is not a string. ``fn`` runs once per task attempt, so a lost executor
    repeats the calls of its tasks; ``streaming.answers`` keeps the answers of a long run. ``concurrency``
    spreads the prompts over that many tasks; without it, a table is spread over a few tasks per core.
    """
    return ask_prompts(asked_prompts(prompts), fn, model, concurrency)


def ask_prompts(
    asked: DataFrame, fn: Callable[[str], str], model: str = DEFAULT_MODEL, concurrency: int | None = None
) -> DataFrame:
    """``execute_prompts`` of rows (prompt_id, prompt)."""
    if not concurrency and not asked.isStreaming:
        concurrency = TASKS_PER_CORE * asked.sparkSession.sparkContext.defaultParallelism
    if concurrency:
        asked = asked.repartition(concurrency)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for text in batch["prompt"]:
                try:
                    answer = fn(text)
                    if not isinstance(answer, str):
                        raise TypeError(f"the answer is of type {type(answer).__name__}, not str")
                    answers.append((answer, "success", None, None))
                except Exception as e:  # any failure of user code becomes a row
                    answers.append(("", "error", str(e), type(e).__name__))
            response, status, error, kind = zip(*answers, strict=True) if answers else ([],) * 4
            yield batch.assign(
                response=list(response),
                model=model,
                status=list(status),
                error=list(error),
                error_type=list(kind),
            )

    return asked.mapInPandas(run, RESULT_SCHEMA).withColumn("timestamp", F.current_timestamp())


def failed_requests(results: DataFrame) -> DataFrame:
    """The failure log of an executed batch."""
    return results.filter(F.col("status") == "error").select(
        "prompt_id",
        "error_type",
        F.col("error").alias("error_message"),
        "timestamp",
        F.lit(0).alias("retry_count"),
        error_severity(F.col("error_type")).alias("severity"),
    )


def error_stats(failures: DataFrame) -> DataFrame:
    """Failures by error type and by severity, as rows (dimension, value, count)."""
    by_type = failures.select("error_type", error_severity(F.col("error_type")).alias("severity"))
    counted = by_type.groupingSets(
        [["error_type"], ["severity"]], "error_type", "severity"
    ).agg(F.count(F.lit(1)).alias("count"), F.grouping("error_type").alias("of_severity"))
    of_severity = F.col("of_severity") == 1
    return counted.select(
        F.when(of_severity, "severity").otherwise("error_type").alias("dimension"),
        F.when(of_severity, F.col("severity")).otherwise(F.col("error_type")).alias("value"),
        "count",
    )
