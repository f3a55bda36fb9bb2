"""Reading, scaling and rounding numbers."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from respeval.functions.text import strip

_DECIMAL = r"[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?"
_SPECIAL = r"[+-]?(?i:nan|inf|infinity)"

_DIGITS = "".join(
    chr(c) for c in range(0x80, 0x110000) if unicodedata.decimal(chr(c), None) is not None
)
_ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in _DIGITS)


def ascii_digits(text: Column) -> Column:
    """Decimal digits of any script as 0-9; meant for short strings."""
    return F.translate(text, _DIGITS, _ASCII_DIGITS)


def parse_number(text: Column) -> Column:
    """A string as a double, or null unless it is a plain decimal number, NaN or infinity.

    Stricter than a cast, which also takes Java suffixes such as ``4d``.
    """
    bare = strip(text)
    return F.when(bare.rlike(f"^(?:{_DECIMAL}|{_SPECIAL})$"), bare.try_cast("double"))


def number_column(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a double: cast if it is numeric, parsed if it is text."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return parse_number(df[name])
    return df[name].try_cast("double")


def is_finite(value: Column) -> Column:
    return (
        value.isNotNull()
        & ~F.isnan(value)
        & (F.abs(value) != F.lit(float("inf")))
    )


def to_whole(value: Column) -> Column:
    """Truncate to a bigint; null, NaN and infinities give 0."""
    return F.coalesce(F.when(is_finite(value), value).try_cast("bigint"), F.lit(0).cast("bigint"))


# Upper ends of the scales a bare score may be on.
SCALE_TOPS = (5.0, 10.0, 100.0)


def normalize_value(
    value: Column, min_val: float | None = None, max_val: float | None = None
) -> Column:
    """Bring a score to 0-1: linearly if a range is given, else by the smallest scale it fits."""
    value = value.cast("double")
    if min_val is not None and max_val is not None and max_val > min_val:
        scaled = (value - F.lit(float(min_val))) / F.lit(float(max_val) - float(min_val))
        known = F.greatest(F.lit(0.0), F.least(F.lit(1.0), scaled))
    else:
        known = F.when(value < 0, 0.0).when(value <= 1.0, value)
        for top in SCALE_TOPS:
            known = known.when(value <= top, value / F.lit(top))
        known = known.otherwise(1.0)
    return F.when(is_finite(value), known).otherwise(0.0)


def round_binary(value: Column, places: int) -> Column:
    """Round like Python's ``round``: to nearest by the exact binary value, exact ties to even.

    Spark's ``round`` works on the decimal text of the double, which sends 0.0000005 up although
    the double lies below the tie. Here the product with the power of ten is split exactly into
    a double and its error (Dekker), and the error decides ties. Holds while the scaled value
    stays below 2**52; larger values have no digits left to round and pass through.
    """
    power = 10.0**places
    # Veltkamp split of both factors at 2**27 + 1.
    c = F.lit(134217729.0) * value
    high = c - (c - value)
    low = value - high
    p_c = 134217729.0 * power
    p_high = p_c - (p_c - power)
    p_low = power - p_high
    product = value * F.lit(power)
    error = ((high * p_high - product) + high * p_low + low * p_high) + low * p_low
    floor = F.floor(product).cast("double")
    excess = product - floor
    up = (
        (excess > 0.5)
        | ((excess == 0.5) & (error > 0))
        | ((excess == 0.5) & (error == 0) & (F.pmod(floor, F.lit(2.0)) == 1.0))
    )
    # floor() of a product rounded up to a whole number although the true value is below it.
    units = F.when(up, floor + 1).otherwise(floor)
    return F.when(F.abs(product) < float(2**52), units / F.lit(power)).otherwise(value)
