"""Summaries of parts against the whole table."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from respeval.operators import summaries
from respeval.operators.quality import quality_report_columns
from respeval.operators.reports import executive_summary

SCHEMA = "day int, part string, x double, n long, s string, flat double, none double, tags array<string>"


@pytest.fixture
def data(table):
    rng = random.Random(3)
    rows = []
    for i in range(6000):
        day = min(3, int(rng.expovariate(1.0)))  # one day holds most rows
        x = None if day == 2 else rng.choice([rng.gauss(1e6, 1), float(rng.randrange(50)), math.nan, None])
        rows.append((day, rng.choice("ab"), x, rng.choice([None, 2**60 + i, i % 7]), f"s{i % 900}", 2.0, None, [str(i % 5)]))
    return table(rows, SCHEMA).repartition(6).persist()


def rows(df, *keys):
    return {tuple(r[k] for k in keys): r.asDict() for r in df.collect()}


def ranks(values, m):
    return sum(v < m for v in values) / len(values), sum(v <= m for v in values) / len(values)


@pytest.mark.parametrize("by", [[], ["part"]])
def test_merged_parts_equal_the_whole(data, by):
    columns = ["x", "n", "s", "flat", "none", "tags"]
    merged = summaries.merge_summaries(summaries.summarize(data, ["day", "part"], columns), by)
    got = rows(summaries.summary_report(merged, by), *by, "column")
    once = rows(summaries.summary_report(summaries.summarize(data, by, columns), by), *by, "column")
    groups = [()] if not by else [("a",), ("b",)]
    assert len(got) == len(groups) * len(columns) == len(once)
    for g in groups:
        part = data.filter(F.col("part") == g[0]) if g else data
        exact = rows(quality_report_columns(part, columns=columns), "column")
        for c in columns:
            for mine in (got[(*g, c)], once[(*g, c)]):
                theirs = exact[(c,)]
                for k in ("dtype", "null_count", "null_percentage", "min", "max"):
                    assert mine[k] == theirs[k], (c, k)
                for k in ("mean", "std"):
                    assert mine[k] == pytest.approx(theirs[k], rel=1e-12, abs=1e-12) if theirs[k] is not None else mine[k] is None
                error = summaries.distinct_error() * theirs["unique_values"]
                assert abs(mine["unique_values"] - theirs["unique_values"]) <= error
                values = [r[0] for r in part.select(F.col(c)).collect() if r[0] is not None and r[0] == r[0]]
                if c in ("x", "n", "flat"):
                    low, high = ranks(values, mine["median"])
                    assert low - summaries.rank_error() <= 0.5 <= high + summaries.rank_error()
                else:
                    assert mine["median"] is None


def test_merging_twice_and_in_any_order(data):
    daily = summaries.summarize(data, ["day", "part"], ["x", "s"])
    twice = summaries.merge_summaries(summaries.merge_summaries(daily, ["part"]))
    once = summaries.merge_summaries(daily)
    names = ("column", "rows", "nulls", "mean", "min", "max", "good_on_one", "good_on_five")
    a, b = ([[r[n] for n in names] for r in df.orderBy("place").collect()] for df in (once, twice))
    assert [r[:3] for r in a] == [r[:3] for r in b]
    assert a[0][3:] == pytest.approx(b[0][3:]) and a[1][3:] == b[1][3:]
    squares = [df.filter("column = 'x'").first().squares for df in (once, twice)]
    assert squares[0] == pytest.approx(squares[1], rel=1e-12)


def test_scores(table):
    rng = random.Random(8)
    rows_ = [(rng.choice("abc"), None if i % 40 == 0 else rng.choice([rng.random(), 0.7])) for i in range(3000)]
    scored = table(rows_, "model string, aggregated_score double")
    parts = summaries.summarize(scored, ["model"])
    (got,) = summaries.summary_of_scores(summaries.merge_summaries(parts), "aggregated_score").collect()
    (exact,) = executive_summary(scored).collect()
    for k in exact.asDict():
        if k == "median_score":
            low, high = ranks([r[1] * 5 for r in rows_ if r[1] is not None], got[k])
            assert low - summaries.rank_error() <= 0.5 <= high + summaries.rank_error()
        else:
            assert got[k] == pytest.approx(exact[k]) if isinstance(exact[k], float) else got[k] == exact[k]
    assert [r.model for r in summaries.summary_of_scores(parts, "aggregated_score", ["model"]).orderBy("model").collect()] == ["a", "b", "c"]


def test_empty_table(table):
    empty = table([], SCHEMA)
    report = summaries.summary_report(summaries.summarize(empty)).collect()
    assert {(r.column, r.null_count, r.unique_values, r.median) for r in report} == {
        (c, 0, 0, None) for c in empty.columns
    }
    assert summaries.merge_summaries(summaries.summarize(empty, ["day"])).count() == 0


def test_one_pass(table):
    """The rows are aggregated once; nothing is exploded before."""
    plan = summaries.summarize(table([], SCHEMA), ["day"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    assert plan.index("Generate inline") < plan.index("Exchange")


@pytest.mark.parametrize("few", [0, 100_000])
def test_summary_with_few_or_many_values(table, monkeypatch, few):
    from respeval.operators import reports

    monkeypatch.setattr(reports, "FEW_VALUES", few)
    rng = random.Random(2)
    scores = [rng.choice([rng.random(), 0.5, None]) for _ in range(501)]
    (got,) = executive_summary(table([(s,) for s in scores], "aggregated_score double")).collect()
    known = sorted(s for s in scores if s is not None)
    middle = (known[(len(known) - 1) // 2] + known[len(known) // 2]) / 2
    assert got.median_score == pytest.approx(5 * middle)
