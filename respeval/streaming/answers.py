"""Batch execution that can be stopped and started anew.

Every different prompt is a question, named by the SHA-256 digest of model and text, and is asked once. Questions lie in
files; a stream takes some files per micro-batch and stores their answers under the batch's number.
A driver that is lost repeats the batch that it was at; an executor that is lost repeats the calls of
its tasks. All other answers are in the log, from which results are read by a join on the digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from respeval.functions.cost import DEFAULT_MODEL
from respeval.operators.execute import RESULT_SCHEMA, ask_prompts, asked_prompts
from respeval.operators.prompts import pending_prompts
from respeval.sources.results import load_baseline

QUESTIONS_PER_FILE = 1000
# A batch takes a second besides its calls, so without a given size there are so many at most, of so many files at least.
BATCHES = 32
FILES_PER_BATCH = 8
_QUESTION = "digest string, prompt string"
_ANSWER = f"digest string, {RESULT_SCHEMA}, timestamp timestamp"


def prompt_digest(prompt: Column, model: str) -> Column:
    return F.sha2(F.concat(F.lit(model), F.lit("\n"), prompt), 256)


def submit_prompts(
    prompts: DataFrame, path: str, model: str = DEFAULT_MODEL, per_file: int = QUESTIONS_PER_FILE
) -> None:
    """Add the prompts that were not submitted before to the questions under ``path``."""
    asked = asked_prompts(prompts).select(prompt_digest(F.col("prompt"), model).alias("digest"), "prompt")
    new = asked.dropDuplicates(["digest"])
    before = load_baseline(prompts.sparkSession, f"{path}/questions")
    if before is not None:
        new = pending_prompts(new, before, "digest")
    # Files are written by the tasks of the shuffle that dropped the copies.
    new.write.mode("append").option("maxRecordsPerFile", per_file).parquet(f"{path}/questions")


def answer_questions(
    spark: SparkSession,
    path: str,
    fn: Callable[[str], str],
    model: str = DEFAULT_MODEL,
    concurrency: int | None = None,
    files_per_batch: int | None = None,
    then: Callable[[int], None] | None = None,
) -> StreamingQuery:
    """Ask all questions that have no answer yet, some files at a time; ``then`` is called after each batch.

    Without ``files_per_batch`` a batch has ``FILES_PER_BATCH`` files, or more where the questions would take over
    ``BATCHES`` batches: the calls a lost driver repeats are those of one batch.
    """
    if files_per_batch is None:
        files = len(spark.read.schema(_QUESTION).parquet(f"{path}/questions").inputFiles())
        files_per_batch = max(FILES_PER_BATCH, -(-files // BATCHES))

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        named = batch.select(F.col("digest").alias("prompt_id"), "prompt")
        answers = ask_prompts(named, fn, model, concurrency).withColumn("digest", F.col("prompt_id"))
        answers.write.mode("overwrite").parquet(f"{path}/answers/batch_id={batch_id}")
        if then is not None:
            then(batch_id)

    questions = spark.readStream.schema(_QUESTION).option("maxFilesPerTrigger", files_per_batch)
    query = (
        questions.parquet(f"{path}/questions")
        .writeStream.foreachBatch(on_batch)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def answer_log(spark: SparkSession, path: str) -> DataFrame:
    """All answers so far, one per question."""
    return spark.read.schema(f"{_ANSWER}, batch_id long").parquet(f"{path}/answers").drop("batch_id")


def answered_prompts(prompts: DataFrame, path: str, model: str = DEFAULT_MODEL) -> DataFrame:
    """The results of those prompts that have an answer, as ``execute_prompts`` gives them."""
    asked = asked_prompts(prompts).withColumn("digest", prompt_digest(F.col("prompt"), model))
    log = answer_log(prompts.sparkSession, path).drop("prompt_id", "prompt")
    joined = asked.join(log, "digest")
    return joined.select("prompt_id", "prompt", "response", "model", "status", "error", "error_type", "timestamp")


def execute_resumable(
    prompts: DataFrame,
    fn: Callable[[str], str],
    path: str,
    model: str = DEFAULT_MODEL,
    concurrency: int | None = None,
    per_file: int = QUESTIONS_PER_FILE,
    files_per_batch: int | None = None,
) -> DataFrame:
    """``execute_prompts`` with its answers logged under ``path``; a call after a failure goes on from there.

    Prompts without a text in common with what was asked before are asked as well, so the table may grow.
    """
    submit_prompts(prompts, path, model, per_file)
    answer_questions(prompts.sparkSession, path, fn, model, concurrency, files_per_batch)
    return answered_prompts(prompts, path, model)
