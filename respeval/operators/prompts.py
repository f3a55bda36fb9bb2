"""Prompt checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respeval.operators.quality import duplicated_keys
from respeval.operators.scoring import columns_of
from respeval.sources.storage import broadcast_if_small

# The form a prompt must have.
ID_PATTERN = "^[A-Za-z0-9_-]+$"
DIFFICULTIES = ("easy", "medium", "hard")
MIN_TEXT_CHARS = 10
SHORT_TEXT_CHARS = 20


def _row_issues(df: DataFrame) -> dict[str, Column]:
    """Issue code -> condition, for the columns the table has."""
    have = set(df.columns)

    def null_or_absent(name: str) -> Column:
        return df[name].isNull() if name in have else F.lit(True)

    issues = {f"missing_{n}": null_or_absent(n) for n in ("id", "category", "text")}
    issues["no_prompt_text"] = null_or_absent("prompt") & null_or_absent("text")
    if "id" in have:
        issues["bad_id"] = ~df["id"].rlike(ID_PATTERN)
    if "difficulty" in have:
        issues["bad_difficulty"] = ~df["difficulty"].isin(*DIFFICULTIES)
    if "tags" in have:
        issues["bad_tags"] = F.exists(df["tags"], lambda t: t.isNull())
    if "text" in have:
        issues["text_too_short"] = F.length(df["text"]) < MIN_TEXT_CHARS
    chars = F.length(df["text"]) if "text" in have else F.lit(None)
    issues["text_very_short"] = F.coalesce(chars, F.lit(0)) < SHORT_TEXT_CHARS
    criteria = df.schema["expected_criteria"].dataType if "expected_criteria" in have else None
    if isinstance(criteria, T.StructType) and {"min_tokens", "max_tokens"} <= set(criteria.names):
        low, high = df["expected_criteria.min_tokens"], df["expected_criteria.max_tokens"]
        issues["min_tokens_over_max"] = (low != 0) & (high != 0) & (low > high)
    return issues


def lint_prompts(df: DataFrame) -> DataFrame:
    """Add ``issues``, the codes of everything wrong with a prompt, empty if it is fine.

    Every prompt of a repeated id gets ``duplicate_id``.
    """
    issues = _row_issues(df)
    linted = df
    if "id" in df.columns:
        repeated = duplicated_keys(df, "id").select(
            F.col("id").alias("__id"), F.lit(True).alias("__repeated")
        )
        linted = df.join(broadcast_if_small(repeated), df["id"].eqNullSafe(F.col("__id")), "left")
        issues["duplicate_id"] = F.col("__repeated")
    codes = F.array_compact(F.array(*[F.when(c, code) for code, c in issues.items()]))
    return linted.select(*columns_of(df), codes.alias("issues"))


def lint_prompt_files(files: DataFrame) -> DataFrame:
    """Add ``issues`` of the file itself to rows (file, metadata, prompts)."""
    meta = F.col("metadata")
    codes = {
        "missing_metadata": meta.isNull(),
        "missing_version": meta.isNotNull() & meta["version"].isNull(),
        "missing_description": meta.isNotNull() & meta["description"].isNull(),
        "missing_prompts": F.col("prompts").isNull(),
        "no_prompts": F.size("prompts") == 0,
    }
    found = F.array_compact(F.array(*[F.when(c, code) for code, c in codes.items()]))
    return files.withColumn("issues", found)


def pending_prompts(prompts: DataFrame, done: DataFrame, key: str = "prompt_id") -> DataFrame:
    """Prompts without a stored result. Results are reduced to one row per id first."""
    return prompts.join(broadcast_if_small(done.select(key).distinct()), key, "left_anti")
