"""Pricing of responses and usage totals."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respeval.functions.cost import (
    DEFAULT_MODEL,
    PRICES,
    TokenCounter,
    estimate_tokens,
    normalize_model,
    price_columns,
    request_cost,
)
from respeval.functions.numbers import number_column, round_binary, to_whole
from respeval.functions.text import first_non_empty
from respeval.operators.scoring import present
from respeval.sources.storage import broadcast_if_small

PRICE_LIST_SCHEMA = "price_key string, input_price double, output_price double"


def _tokens(df: DataFrame, given: str, text: Column, counter: TokenCounter) -> Column:
    counted = counter(text).cast("bigint")
    if given not in df.columns:
        return counted
    missing = df[given].isNull()
    if isinstance(df.schema[given].dataType, (T.FloatType, T.DoubleType)):
        missing = missing | F.isnan(df[given])
    return F.when(missing, counted).otherwise(to_whole(number_column(df, given)))


def with_tokens(df: DataFrame, counter: TokenCounter = estimate_tokens) -> DataFrame:
    """Add ``input_tokens`` and ``output_tokens``: the given counts, else counted from the text."""
    prompt = first_non_empty(*present(df, "prompt", "prompt_text"))
    response = first_non_empty(*present(df, "response"))
    return df.select(
        "*",
        _tokens(df, "prompt_tokens", prompt, counter).alias("input_tokens"),
        _tokens(df, "response_tokens", response, counter).alias("output_tokens"),
    )


def _model(df: DataFrame) -> Column:
    return df["model"] if "model" in df.columns else F.lit(DEFAULT_MODEL)


def price_requests(
    df: DataFrame, prices: Mapping[str, tuple[float, float]] | DataFrame = PRICES
) -> DataFrame:
    """Add ``cost`` to a table with token counts. Unknown models pay the default model's price.

    A price list given as a mapping becomes part of the plan, so nothing is joined. A price list
    given as a table (``PRICE_LIST_SCHEMA``) is joined, and broadcast only if it is short.
    """
    if not isinstance(prices, DataFrame):
        price_in, price_out = price_columns(_model(df), prices)
        cost = request_cost(F.col("input_tokens"), F.col("output_tokens"), price_in, price_out)
        return df.select("*", cost.alias("cost"))
    # Private names, as the table may have columns of these names.
    listed = prices.select(
        F.col("price_key").alias("__key"),
        F.col("input_price").alias("__in"),
        F.col("output_price").alias("__out"),
    )
    fallback = listed.filter(F.col("__key") == DEFAULT_MODEL)
    joined = df.withColumn("__model", normalize_model(_model(df))).join(
        broadcast_if_small(listed), F.col("__model") == F.col("__key"), "left"
    )
    price_in = F.coalesce("__in", fallback.select("__in").scalar())
    price_out = F.coalesce("__out", fallback.select("__out").scalar())
    cost = request_cost(F.col("input_tokens"), F.col("output_tokens"), price_in, price_out)
    return joined.select(*[F.col(c) for c in df.columns], cost.alias("cost"))


def row_cost(
    df: DataFrame,
    prices: Mapping[str, tuple[float, float]] | DataFrame = PRICES,
    counter: TokenCounter = estimate_tokens,
) -> DataFrame:
    """Add ``input_tokens``, ``output_tokens`` and ``cost`` to a response table."""
    return price_requests(with_tokens(df, counter), prices)


def cost_summary(usage: DataFrame, budget_limit: float | None = None) -> DataFrame:
    """One row: requests, tokens, cost, averages, and what is left of the budget."""
    requests = F.count(F.lit(1))
    total_in = F.coalesce(F.sum("input_tokens"), F.lit(0)).cast("bigint")
    total_out = F.coalesce(F.sum("output_tokens"), F.lit(0)).cast("bigint")
    totals = usage.agg(
        requests.alias("total_requests"),
        total_in.alias("total_input_tokens"),
        total_out.alias("total_output_tokens"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("spent"),
    )
    divisor = F.greatest(F.lit(1), F.col("total_requests"))
    tokens = F.col("total_input_tokens") + F.col("total_output_tokens")
    spent = F.col("spent")
    if budget_limit:
        limit = F.lit(float(budget_limit))
        remaining = round_binary(limit - spent, 4)
        used = round_binary(spent / limit * 100, 2)
    else:
        remaining, used = F.lit(None).cast("double"), F.lit(0.0)
    return totals.select(
        "total_requests",
        "total_input_tokens",
        "total_output_tokens",
        tokens.alias("total_tokens"),
        round_binary(spent, 4).alias("total_cost"),
        (tokens / divisor).alias("avg_tokens_per_request"),
        round_binary(spent / divisor, 4).alias("average_cost_per_call"),
        F.lit(budget_limit).cast("double").alias("budget_limit"),
        remaining.alias("budget_remaining"),
        used.alias("budget_utilized_percent"),
    )


def cost_by_model(usage: DataFrame) -> DataFrame:
    """Cost per model name as given, summed over costs rounded to six places per request."""
    return usage.groupBy("model").agg(
        F.round(F.sum(round_binary(F.col("cost"), 6)), 6).alias("cost")
    )


def usage_log(df: DataFrame) -> DataFrame:
    """The per-request log of a priced table."""
    return df.select(
        *present(df, "timestamp", "model", "prompt_id"),
        "input_tokens",
        "output_tokens",
        round_binary(F.col("cost"), 6).alias("cost"),
    )
