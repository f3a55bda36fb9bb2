from __future__ import annotations

import numpy as np
import pytest

from respeval.operators.reports import (
    accuracy_histogram,
    defect_summary,
    dimension_averages,
    executive_summary,
    execution_summary,
    histogram,
    overall_histogram,
    report_sample,
    report_statistics,
    run_summary,
)


def test_statistics(table, one):
    rows = [("0.8", "x", 4.0), ("0.4", "", 2.0)]
    row = one(report_statistics(table(rows, "score_accuracy string, tone string, overall_score double")))
    assert row == {
        "total_evaluations": 2,
        "mean_accuracy": pytest.approx(3.0),
        "mean_reasoning": 0.0,
        "mean_tone": 0.0,
        "mean_completeness": 0.0,
        "mean_overall": 3.0,
    }


def test_first_present_column_decides(table, one):
    df = table([(None, 4.0, 0.5)], "score_tone double, tone double, aggregated_score double")
    row = one(report_statistics(df))
    assert (row["mean_tone"], row["mean_overall"]) == (0.0, 2.5)


@pytest.mark.parametrize(
    ("schema", "values", "mean", "insight", "varied"),
    [
        ("aggregated_score double", [0.9, 0.8], 4.25, "good", False),
        ("aggregated_score double", [0.95, 0.93], 4.7, "excellent", False),
        ("overall_score double", [4.5, 1.5], 3.0, "acceptable", True),
        ("overall_score double", [2.0, 1.8], 1.9, "below_expectations", False),
        ("other string", ["0.7", "0.7"], 3.5, "good", False),
        ("other string", ["3.5", "x"], 3.5, "good", False),
    ],
)
@pytest.mark.parametrize("approximate", [False, True])
def test_executive_summary(table, one, schema, values, mean, insight, varied, approximate):
    row = one(executive_summary(table([(v,) for v in values], schema), approximate))
    assert row["average_score"] == pytest.approx(mean)
    assert (row["insight"], row["high_variance"]) == (insight, varied)
    assert row["total_evaluations"] == 2


def test_success_rate_is_over_all_rows(table, one):
    df = table([(0.7,), (0.6,), (None,), (0.9,)], "aggregated_score double")
    row = one(executive_summary(df))
    assert row["success_rate"] == 50.0
    assert row["median_score"] == pytest.approx(3.5)
    assert row["std_dev"] == pytest.approx(5 * np.std([0.7, 0.6, 0.9], ddof=1))


def test_summary_of_one_and_no_row(table, one):
    assert one(executive_summary(table([(3.0,)], "overall_score double")))["std_dev"] is None
    row = one(executive_summary(table([], "overall_score double")))
    assert (row["total_evaluations"], row["average_score"], row["success_rate"]) == (0, None, 0.0)


def test_dimension_averages(table):
    df = table(
        [(0.4, "0.9", "note", 4.0), (0.6, None, "note", 3.0)],
        "score_a double, score_b string, score_b_notes string, score_c double",
    )
    got = [tuple(r) for r in dimension_averages(df).collect()]
    assert got == [("c", 3.5, 3.5), ("b", 0.9, 4.5), ("a", 0.5, 2.5)]
    assert dimension_averages(df.select("score_b_notes")).collect() == []
    assert dimension_averages(table([(1,)], "x int")).collect() == []


@pytest.mark.parametrize("as_array", [False, True])
def test_defect_summary(table, as_array):
    if as_array:
        rows, schema = [(["D01", " D02 "],), ([],), (None,), (["D01", ""],)], "defects array<string>"
    else:
        rows, schema = [("D01,D02",), (" D01 , ,",), ("",), (None,), ("None",)], "defects string"
    got = {r.defect: r["count"] for r in defect_summary(table(rows, schema)).collect()}
    assert got == ({"D01": 2, "D02": 1} if as_array else {"D01": 2, "D02": 1, "None": 1})


def test_run_summary(table, one):
    df = table([(0.8, 10, 5, 0.5), (0.6, 1, 1, 0.25)],
               "aggregated_score double, input_tokens long, output_tokens long, cost double")
    row = one(run_summary(df))
    assert row["average_score"] == pytest.approx(3.5)
    assert (row["success_rate"], row["total_tokens"], row["total_cost"]) == (50.0, 17, 0.75)
    assert one(run_summary(table([(1,)], "x int")))["average_score"] is None


def test_execution_summary(table, one):
    df = table([("success",), ("error",), (None,), ("success",)], "status string")
    assert one(execution_summary(df)) == {
        "total": 4, "success": 2, "failed": 2, "success_rate": 50.0
    }


@pytest.mark.parametrize("bins", [1, 5, 10])
@pytest.mark.parametrize(
    "values",
    [[0.1 * i for i in range(60)], [3.0] * 4, [0.3, 0.6, 0.7, 0.9, 1.2], [-1.0, 1e9], [1.0]],
)
def test_histogram_is_numpys(table, values, bins):
    got = histogram(table([(v,) for v in [*values, None]], "value double"), bins).collect()
    counts, edges = np.histogram(values, bins)
    assert [r["count"] for r in got] == list(counts)
    assert [r.low for r in got] + [got[-1].high] == pytest.approx(list(edges))


def test_histogram_of_nothing(table):
    got = histogram(table([], "value double"), 2).collect()
    assert [tuple(r) for r in got] == [(0, 0.0, 0.5, 0), (1, 0.5, 1.0, 0)]


def test_accuracy_histogram_fallbacks(table):
    df = table([("2", 1.0), ("", 0.8), (None, None), ("x", 1.0)], "accuracy string, score_accuracy double")
    got = accuracy_histogram(df).collect()
    assert [r["count"] for r in got] == [1, 0, 1, 0, 2]  # 0, 2, 4, 5
    zero = accuracy_histogram(table([(0.8,)], "score_accuracy double")).collect()
    assert [r["count"] for r in zero] == [0, 0, 1, 0, 0]
    with pytest.raises(ValueError):
        overall_histogram(df)


def test_sample(table):
    rows = [(i, f"<{i}>", "&" * n, None, None, a, d) for i, (n, a, d) in enumerate(
        [(20, 0.5, "D01"), (101, 4.0, None), (100, None, "a&b")])]
    df = table(rows, "seq int, prompt_id string, prompt_text string, model string, "
                     "overall_score string, aggregated_score double, defects string")
    got = report_sample(df, ["seq"], 2).collect()
    assert [r.sample_id for r in got] == ["&lt;0&gt;", "&lt;1&gt;"]
    assert got[0].prompt == "&amp;" * 20
    assert got[1].prompt == "&amp;" * 20 + "..."
    assert [r.score for r in got] == [2.5, 4.0]
    assert [r.model for r in got] == ["", ""]
    whole = report_sample(df, ["seq"]).collect()
    assert (whole[2].prompt, whole[2].score, whole[2].defects) == ("&amp;" * 20, 0.0, "a&amp;b")
