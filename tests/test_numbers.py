from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from respeval.functions.numbers import normalize_value, parse_number, round_binary, to_whole


def test_round_is_pythons(table):
    rng = random.Random(3)
    values = [rng.randrange(0, 4000) * 5e-7 for _ in range(3000)]
    values += [rng.uniform(-1000, 1000) for _ in range(1000)]
    values += [2.675, 0.5e-6, 1.5e-6, -2.675, 0.125, 0.375, 1e15 + 0.5, 4.5e15, 0.0]
    df = table([(v,) for v in values], "v double")
    for places in (0, 2, 4, 6):
        rows = df.select("v", round_binary(F.col("v"), places).alias("r")).collect()
        assert all(r.r == round(r.v, places) for r in rows), places


@pytest.mark.parametrize(
    ("text", "value"),
    [("10", 10.0), (" 3.5 ", 3.5), (".5", 0.5), ("-1e3", -1000.0), ("4.", 4.0), ("4d", None),
     ("0x1p3", None), ("", None), ("abc", None), ("inf", math.inf), ("-Infinity", -math.inf)],
)
def test_parse_number(table, one, text, value):
    df = table([(text,)], "t string").select(parse_number(F.col("t")).alias("x"))
    assert one(df)["x"] == value


def test_to_whole(table):
    values = [10.0, 20.0, 30.5, -30.5, None, math.nan, math.inf]
    df = table([(v,) for v in values], "v double").select(to_whole(F.col("v")).alias("n"))
    assert [r.n for r in df.collect()] == [10, 20, 30, -30, 0, 0, 0]


def test_normalize_value(table):
    values = [None, math.nan, math.inf, -1.0, 0.4, 1.0, 4.0, 8.0, 60.0, 1000.0]
    df = table([(v,) for v in values], "v double")
    rows = df.select(normalize_value(F.col("v")).alias("a"), normalize_value(F.col("v"), 2, 6).alias("b"))
    got = rows.collect()
    assert [r.a for r in got] == [0, 0, 0, 0, 0.4, 1.0, 0.8, 0.8, 0.6, 1.0]
    assert [r.b for r in got] == [0, 0, 0, 0, 0, 0, 0.5, 1.0, 1.0, 1.0]
