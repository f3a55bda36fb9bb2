"""Model names, prices and token counts."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

# USD per million tokens as (input, output).
PRICES: dict[str, tuple[float, float]] = {
    "gpt-4": (30.00, 60.00),
    "gpt-4-turbo-preview": (10.00, 30.00),
    "gpt-3.5-turbo": (0.50, 1.50),
    "claude-sonnet-4-6": (3.00, 15.00),
    "claude-opus-4-6": (15.00, 75.00),
    "claude-haiku-4-5-20251001": (0.80, 4.00),
}
DEFAULT_MODEL = "gpt-4"
# The first fragment found in the lower-case model name decides its price key.
NAME_FRAGMENTS: tuple[tuple[str, str], ...] = (
    ("gpt-4-turbo", "gpt-4-turbo-preview"),
    ("gpt-4", "gpt-4"),
    ("gpt-3.5", "gpt-3.5-turbo"),
    ("gpt-35", "gpt-3.5-turbo"),
    ("sonnet", "claude-sonnet-4-6"),
    ("opus", "claude-opus-4-6"),
    ("haiku", "claude-haiku-4-5-20251001"),
)
CHARS_PER_TOKEN = 4


def normalize_model(model: Column) -> Column:
    lowered = F.lower(model)
    key = F.when(F.lit(False), model)
    for fragment, name in NAME_FRAGMENTS:
        key = key.when(lowered.contains(fragment), name)
    return key.otherwise(model)


def estimate_tokens(text: Column) -> Column:
    return F.floor(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("bigint")


TokenCounter = Callable[[Column], Column]


def price_columns(
    model: Column, prices: Mapping[str, tuple[float, float]] = PRICES
) -> tuple[Column, Column]:
    """Input and output price of a model from a price list held in the plan."""
    key = normalize_model(model)
    default = prices[DEFAULT_MODEL]

    def lookup(side: int) -> Column:
        entries = [F.lit(v) for name, pair in prices.items() for v in (name, float(pair[side]))]
        listed = F.try_element_at(F.create_map(*entries), key)
        return F.coalesce(listed, F.lit(float(default[side])))

    return lookup(0), lookup(1)


def request_cost(
    input_tokens: Column, output_tokens: Column, input_price: Column, output_price: Column
) -> Column:
    million = F.lit(1_000_000.0)
    return (input_tokens / million) * input_price + (output_tokens / million) * output_price
