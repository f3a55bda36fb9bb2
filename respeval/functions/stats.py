"""Tail probabilities of the regression tests."""

from __future__ import annotations

import math
import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The UDF below ships with its task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Beyond so many degrees of freedom the normal distribution is used.
LARGE_DF = 1e6
_TINY = 1e-300


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > _TINY else _TINY)
    value = d
    for m in range(1, 500):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        step = 1.0
        for term in (even, odd):
            d = 1.0 + term * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + term / c
            c = c if abs(c) > _TINY else _TINY
            step = c * d
            value *= step
        if abs(step - 1.0) < 1e-15:
            break
    return value


def incomplete_beta(a: float, b: float, x: float, rest: float) -> float:
    """Regularised incomplete beta function at ``x``, with ``rest = 1 - x`` given exactly."""
    if x <= 0.0:
        return 0.0
    if rest <= 0.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(rest)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, rest) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student's t with ``df`` degrees of freedom."""
    if math.isnan(t) or math.isnan(df) or df <= 0:
        return math.nan
    if math.isinf(t):
        return 0.0
    if df > LARGE_DF:
        # Differences of log-gammas lose their digits here; the error of this is of order 1 / df ** 2.
        z = abs(t) * (1 - 1 / (4 * df)) / math.sqrt(1 + t * t / (2 * df))
        return math.erfc(z / math.sqrt(2))
    square = t * t
    return incomplete_beta(df / 2.0, 0.5, df / (df + square), square / (df + square))


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    """Applied to one row per metric, never to the data."""
    return pd.Series(
        [
            None if pd.isna(a) or pd.isna(b) else t_two_sided(float(a), float(b))
            for a, b in zip(t, df, strict=True)
        ],
        dtype="float64",
    )


def chi_square_tail_4(x: Column) -> Column:
    """P(X >= x) for chi-square with 4 degrees of freedom, in closed form."""
    return F.exp(-x / 2) * (1 + x / 2)
