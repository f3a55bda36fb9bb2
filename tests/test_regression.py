from __future__ import annotations

import math
import random
import statistics

import pytest

from respeval.functions.stats import t_two_sided
from respeval.operators.regression import (
    grade_distribution,
    grade_regression,
    metric_tests,
    metric_verdicts,
    regression_report,
    run_verdict,
)

SCHEMA = "overall_score double, score_accuracy double, grade string"


def run(table, values, grades=None):
    grades = grades or ["A"] * len(values)
    return table([(v, v / 5 if v is not None else None, g) for v, g in zip(values, grades)], SCHEMA)


def test_t_tail_closed_forms():
    for t in (0.0, 0.3, 1.0, 2.5, 40.0, 1e6):
        assert t_two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), abs=1e-12)
        assert t_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), abs=1e-12)
        assert t_two_sided(-t, 2) == t_two_sided(t, 2)
    for z in (0.5, 1.96, 4.0):
        assert t_two_sided(z, 1e8) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6)
    assert t_two_sided(math.inf, 5) == 0.0
    assert math.isnan(t_two_sided(math.nan, 5))
    assert math.isnan(t_two_sided(1.0, 0))


def test_t_tail_keeps_small_values():
    # With 4 degrees of freedom the tail is 1 - s (3 - s**2) / 2 with s = t / sqrt(4 + t**2).
    t = 200.0
    s = t / math.sqrt(4 + t * t)
    gap = (4 / (t * t + 4)) / (1 + s)  # 1 - s without cancellation
    assert t_two_sided(t, 4) == pytest.approx(gap * gap * (3 - gap) / 2, rel=1e-9)


def test_metric_numbers(table):
    rng = random.Random(9)
    a = [rng.gauss(4, 0.5) for _ in range(30)]
    b = [rng.gauss(3.8, 0.7) for _ in range(25)]
    rows = {r.metric: r for r in metric_tests(run(table, [*a, None]), run(table, b)).collect()}
    assert set(rows) == {"Overall Score", "Accuracy"}
    r = rows["Overall Score"]
    change = statistics.mean(b) - statistics.mean(a)
    va, vb = statistics.variance(a), statistics.variance(b)
    pooled = (29 * va + 24 * vb) / 53
    assert (r.baseline_n, r.current_n, r.degrees_of_freedom) == (30, 25, 53)
    assert r.cohens_d == pytest.approx(change / math.sqrt((va + vb) / 2))
    assert r.t_statistic == pytest.approx(change / math.sqrt(pooled * (1 / 30 + 1 / 25)))
    assert r.percent_change == pytest.approx(change / statistics.mean(a) * 100)


BASE = [4.1, 4.2, 4.0, 4.3, 4.1, 4.2, 4.0, 4.3, 4.1, 4.1]


@pytest.mark.parametrize(
    ("shift", "regressed", "improved"), [(0.04, False, False), (-2.0, True, False), (0.5, False, True)]
)
def test_verdicts(table, shift, regressed, improved):
    rows = metric_verdicts(run(table, BASE), run(table, [v + shift for v in BASE])).collect()
    assert {r.is_regression for r in rows} == {regressed}
    assert {r.is_improvement for r in rows} == {improved}


def test_no_variance(table):
    (r, _) = metric_verdicts(run(table, [3.0] * 6), run(table, [2.0] * 6)).collect()
    assert (r.t_statistic, r.p_value, r.cohens_d) == (-math.inf, 0.0, 0.0)
    assert (r.is_significant, r.is_regression) == (True, False)
    (r, _) = metric_verdicts(run(table, [3.0] * 6), run(table, [3.0] * 6)).collect()
    assert (r.t_statistic, r.p_value, r.is_significant) == (None, None, False)
    zero = metric_verdicts(run(table, [0.0] * 6), run(table, [1.0] * 6)).collect()[0]
    assert (zero.percent_change, zero.is_improvement) == (0.0, False)


def test_grades(table, one):
    good = ["A"] * 6 + ["B"] * 4
    bad = ["F"] * 8 + ["D"] * 2
    base, worse = run(table, BASE, good), run(table, BASE, bad)
    row = one(grade_regression(base, worse))
    expected = sum((c - b) ** 2 / b for b, c in zip((7, 5, 1, 1, 1), (1, 1, 1, 3, 9)))
    assert row["chi2"] == pytest.approx(expected)
    assert row["p_value"] == pytest.approx(math.exp(-expected / 2) * (1 + expected / 2))
    assert (row["fail_increase"], row["is_regression"]) == (100.0, True)
    assert one(grade_regression(worse, base))["is_regression"] is False


def test_unequal_sizes_are_not_tested_unless_rescaled(table, one):
    base = run(table, BASE, ["A"] * 10)
    worse = run(table, BASE * 3, ["F"] * 30)
    row = one(grade_regression(base, worse))
    assert (row["chi2"], row["p_value"], row["is_regression"]) == (0.0, 1.0, False)
    row = one(grade_regression(base, worse, rescale=True))
    scale = 35 / 15
    expected = (1 - 11 * scale) ** 2 / (11 * scale) + (31 - scale) ** 2 / scale
    expected += 3 * (1 - scale) ** 2 / scale
    assert row["chi2"] == pytest.approx(expected)
    assert row["is_regression"] is True


def test_report_and_verdict(table, one):
    base = run(table, BASE, ["A"] * 10)
    worse = run(table, [v - 2 for v in BASE], ["D"] * 10)
    report = regression_report(base, worse)
    assert {r.metric: r.status for r in report.collect()} == {
        "Overall Score": "regression", "Accuracy": "regression", "Grade Distribution": "regression"
    }
    assert one(run_verdict(report)) == {
        "has_regression": True,
        "reason": None,
        "regressions": ["Accuracy", "Grade Distribution", "Overall Score"],
        "improvements": [],
        "stable_metrics": [],
    }
    same = one(run_verdict(regression_report(base, base)))
    assert (same["has_regression"], same["stable_metrics"]) == (False, ["Accuracy", "Overall Score"])


def test_too_few_rows_and_no_baseline(table, one):
    base = run(table, BASE)
    few = regression_report(base, run(table, [1.0, 2.0]))
    assert {r.status for r in few.collect()} == {"skipped"}
    verdict = one(run_verdict(few))
    assert (verdict["has_regression"], verdict["reason"]) == (
        False, "Insufficient samples (need at least 5)"
    )
    none = one(run_verdict(regression_report(None, base)))
    assert (none["has_regression"], none["reason"]) == (False, "No baseline available")


def test_only_shared_metrics(table):
    base = run(table, BASE).drop("score_accuracy", "grade")
    assert [r.metric for r in regression_report(base, run(table, BASE)).collect()] == ["Overall Score"]
    with pytest.raises(ValueError):
        metric_tests(base.drop("overall_score"), base)


def test_grade_distribution(table):
    rows = [("a", "A"), ("a", "D"), ("a", "x"), ("a", None), ("b", None)]
    got = grade_distribution(table(rows, "run string, grade string")).collect()
    shares = {(r.run, r.grade): (r["count"], r.share, r.fail_pct) for r in got}
    assert shares[("a", "A")] == (1, pytest.approx(1 / 3), pytest.approx(100 / 3))
    assert shares[("b", "F")] == (0, 0.0, 0.0)
    assert len(got) == 10
