"""Prompt files: JSON objects with ``metadata`` and ``prompts``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respeval.functions.text import strip
from respeval.schemas import PROMPT_FILE


def load_prompt_files(spark: SparkSession, path: str) -> DataFrame:
    """One row (file, metadata, prompts) per file; fails on a file that is no JSON object."""
    files = spark.read.text(path, wholetext=True).select(
        F.input_file_name().alias("file"), "value"
    )
    is_object = strip(F.col("value")).startswith("{")
    checked = F.when(is_object, F.col("value")).otherwise(
        F.raise_error(F.concat(F.lit("prompt file must hold a JSON object: "), F.col("file")))
    )
    parsed = F.from_json(checked, PROMPT_FILE, {"mode": "FAILFAST"})
    return files.select("file", parsed.alias("content")).select("file", "content.*")


def load_prompts(spark: SparkSession, path: str) -> DataFrame:
    """One row per prompt."""
    files = load_prompt_files(spark, path)
    return files.select("file", F.explode("prompts").alias("prompt_row")).select(
        "file", "prompt_row.*"
    )
