"""Regression tests from kept statistics."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from respeval.operators import baselines
from respeval.operators.regression import regression_report
from respeval.plans.workflows import check_against_baselines

SCHEMA = "part string, overall_score double, score_accuracy double, score_tone float, grade string"


def run(table, seed, n, shift=0.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        score = min(5.0, max(0.0, rng.gauss(3 + shift, 1)))
        rows.append((
            rng.choice("abb"), score, rng.choice([None, float("nan"), 1e6 + rng.gauss(shift, 1)]), 0.5,
            rng.choice([None, "A", "B", "D" if shift < 0 else "C", "F" if shift < 0 else "B"]),
        ))
    return table(rows, SCHEMA)


def rows(df, *keys):
    return {tuple(r[k] for k in (*keys, "metric")): r.asDict() for r in df.collect()}


def same(a, b):
    assert set(a) == set(b)
    for k in a:
        for c in ("baseline_value", "current_value", "change", "effect", "statistic", "p_value"):
            if b[k][c] is None:
                assert a[k][c] is None, (k, c)
            else:
                assert a[k][c] == pytest.approx(b[k][c], rel=1e-7, abs=1e-9), (k, c)
        assert (a[k]["status"], a[k]["reason"]) == (b[k]["status"], b[k]["reason"])


@pytest.mark.parametrize("shift", [0.0, -0.8, 0.8])
def test_same_report_as_from_the_rows(table, shift):
    baseline, current = run(table, 1, 300), run(table, 2, 300, shift)
    for rescale in (False, True):
        kept = baselines.merge_statistics(baselines.run_statistics(baseline, ["part"]))
        got = baselines.compare_statistics(kept, baselines.run_statistics(current), rescale=rescale)
        same(rows(got), rows(regression_report(baseline, current, rescale=rescale)))
    assert {r["status"] for r in rows(got).values()} >= ({"stable"} if not shift else {"regression" if shift < 0 else "improvement"})


def test_many_baselines(spark, table, tmp_path):
    """One run against many baselines, large and too small ones; none of their rows is read."""
    path = str(tmp_path / "kept")
    current = run(table, 9, 200, -0.5)
    assert check_against_baselines(spark, current, path).count() == 0
    runs = {f"run{i}": run(table, i, n, shift) for i, (n, shift) in enumerate([(200, 0.0), (4, 0.0), (500, -0.5), (1, 0)])}
    for name, df in runs.items():
        baselines.save_statistics(df, path, name)
    baselines.save_statistics(runs["run0"], path, "run0")  # replaces itself
    got = check_against_baselines(spark, current, path, keep_as="now")
    expected = {}
    for name, df in runs.items():
        expected |= {(name, *k): v for k, v in rows(regression_report(df, current)).items()}
    same(rows(got, "baseline"), expected)
    again = rows(check_against_baselines(spark, current, path), "baseline")
    assert {v["status"] for k, v in again.items() if k[0] == "now"} == {"stable"} and len(again) == len(expected) + 4


def test_plan_reads_no_rows_of_the_baseline(spark, table, tmp_path):
    baselines.save_statistics(run(table, 1, 50), str(tmp_path), "b")
    kept = baselines.load_statistics(spark, str(tmp_path))
    assert kept.count() == 4 and baselines.load_statistics(spark, str(tmp_path / "none")) is None
    report = baselines.compare_statistics(kept, baselines.run_statistics(run(table, 2, 50)), ["baseline"])
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "FileScan parquet [metric" in plan


def test_merging_keeps_digits(table):
    """Large means with small spreads, parts without values."""
    parts = [(p, 1e9 + x, None, None, None) for p, xs in {"a": (0.25, 0.5), "b": (0.75,), "c": ()}.items() for x in xs]
    df = table([*parts, ("c", None, None, None, None)], SCHEMA)
    merged = baselines.merge_statistics(baselines.run_statistics(df, ["part"])).filter("metric = 'Overall Score'")
    (r,) = merged.collect()
    assert (r.rows, r.n, r["mean"], r.squares) == (4, 3, 1e9 + 0.5, pytest.approx(0.125))


def test_a_run_needs_scores(table):
    with pytest.raises(ValueError, match="overall_score"):
        baselines.run_statistics(table([(1,)], "x int"))
    plain = baselines.run_statistics(table([(1.0,), (2.0,)], "overall_score double"))
    assert [r.metric for r in plain.collect()] == ["Overall Score"]
    empty = baselines.run_statistics(table([], SCHEMA)).filter(F.col("metric") == "Overall Score").first()
    assert (empty.rows, empty.n, empty["mean"]) == (0, 0, None)
