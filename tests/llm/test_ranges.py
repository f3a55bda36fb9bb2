"""Numbers of key ranges."""

from __future__ import annotations

import random
import time
from bisect import bisect_right

import numpy as np
import pytest

from respeval.llm import common


def ordered(key):
    return tuple((v is not None, v) if v is not None else (False,) for v in key)


def check(df, keys, cuts):
    bounds = [ordered(c) for c in cuts]
    assert bounds == sorted(set(bounds))
    got = common.with_range(df, keys, cuts).collect()
    for r in got:
        assert r.part == bisect_right(bounds, ordered(tuple(r[k] for k in keys)))
    return got


@pytest.mark.parametrize("kind", ["long", "string", "double", "date"])
def test_ranges_by_bisection(spark, table, kind):
    import datetime

    rng = random.Random(kind)
    make = {
        "long": lambda: rng.choice([2**62 + rng.randrange(9), rng.randrange(50), -(2**60)]),
        "string": lambda: rng.choice(["", "é", "\U0001f642", "￮", f"http://x/{rng.randrange(60)}"]),
        "double": lambda: rng.choice([rng.random(), 0.5, -1e300]),
        "date": lambda: datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(40)),
    }[kind]
    rows = [(rng.choice([None, make(), make(), make()]), rng.choice([None, 1, 2, 2**61 + 1])) for _ in range(600)]
    df = table(rows, f"k {kind}, t long").repartition(3)
    for keys in (["k"], ["k", "t"]):
        cuts = common.range_cuts(df, keys, 25)
        assert len(cuts) > 5
        check(df, keys, cuts)


def test_a_frequent_key_is_cut(table):
    rows = [(7 if i % 3 else i, i) for i in range(3000)]
    df = table(rows, "k long, t long")
    parts = [r.part for r in check(df, ["k", "t"], common.range_cuts(df, ["k", "t"], 10))]
    assert max(parts.count(p) for p in set(parts)) < 600


def test_few_rows(table):
    empty = table([], "k long")
    assert common.range_cuts(empty, ["k"], 9) == [] and common.with_range(empty, ["k"], []).count() == 0
    assert common.range_cuts(table([(None,), (None,)], "k long"), ["k"], 9) == [(None,)]


def test_most_frequent(table):
    counts = [1] * 50 + [2] * 20 + [9] * 5 + [1000, 2**40]
    df = table([(i, c) for i, c in enumerate(counts)], "i int, n long")
    for most, expected in ((0, 0), (1, 1), (6, 2), (7, 7), (26, 7), (27, 27), (76, 27), (77, 77)):
        assert common.most_frequent(df, "n", most).count() == expected
    assert common.most_frequent(df.limit(0), "n", 5).count() == 0


def test_time_grows_with_the_logarithm(spark):
    """8,000 cuts take less than twice as long as 40."""
    rows = np.random.default_rng(1).permutation(300_000)

    def seconds(n):
        cuts = [(int(c),) for c in np.linspace(0, 300_000, n, dtype=int)]
        best = 1e9
        for _ in range(3):
            start = time.perf_counter()
            common._numbers([(np.zeros(len(rows), bool), rows)], cuts)
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(8000) < 2 * seconds(40) + 0.05
