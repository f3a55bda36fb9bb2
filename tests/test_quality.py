from __future__ import annotations

import datetime as dt
import random
import statistics

import pytest

from respeval.operators.quality import (
    clean_results,
    duplicate_ids,
    duplicated_keys,
    grade_consistency,
    invalid_grades,
    quality_report_columns,
    quality_report_table,
    validate_table,
)

RAW = "prompt_id string, prompt string, response string, timestamp string"
SCORED = "prompt_id string, response string, overall_score double, score_accuracy double, grade string"


def issues(df, kind):
    return {(r.issue, r["column"]): r.rows for r in validate_table(df, kind).collect()}


def test_valid_raw(table):
    df = table([("a", "p", "r", "2024-01-01T10:00:00"), ("b", "p", "r", "2024-01-02 10:00:00")], RAW)
    assert issues(df, "raw_results") == {}


def test_raw_issues(table):
    rows = [("a", None, "r", "2024-01-01"), ("a", "p", "r", "yesterday"), (None, "p", "r", None),
            (None, "p", "r", "2024-01-01")]
    df = table(rows, RAW)
    assert issues(df, "raw_results") == {
        ("duplicate_ids", "prompt_id"): 4,
        ("null_values", "prompt_id"): 2,
        ("null_values", "prompt"): 1,
        ("null_values", "timestamp"): 1,
        ("invalid_timestamp", "timestamp"): 1,
    }
    shares = {r["column"]: r.percentage for r in validate_table(df).collect()
              if r.issue == "null_values"}
    assert shares == {"prompt_id": 50.0, "prompt": 25.0, "timestamp": 25.0}


def test_missing_columns(table):
    df = table([("a", "r")], "prompt_id string, response string")
    assert {k for k in issues(df, "scored_results")} == {
        ("missing_column", "overall_score"), ("missing_column", "grade")
    }
    assert issues(df, "anything") == {}


def test_empty_table_has_one_issue(table):
    assert list(issues(table([], RAW), "raw_results")) == [("empty_table", None)]


def test_scored_issues(table):
    rows = [("a", "r", 4.6, 6.0, "A"), ("b", "r", 3.6, -1.0, "A"), ("c", "r", None, None, "F"),
            ("d", "r", 1.6, float("nan"), "E"), ("e", "r", 1.0, 2.0, None)]
    df = table(rows, SCORED)
    found = issues(df, "scored_results")
    assert found[("score_out_of_range", "score_accuracy")] == 2
    assert found[("invalid_grade", "grade")] == 2
    assert found[("inconsistent_grade", "grade")] == 3
    assert found[("null_values", "overall_score")] == 1
    assert ("single_value", "score_accuracy") not in found
    assert {(r.grade, r.n) for r in invalid_grades(df).collect()} == {("E", 1), (None, 1)}
    wrong = {r.prompt_id: r.expected_grade for r in grade_consistency(df).collect()}
    assert wrong == {"b": "B", "d": "D", "e": "F"}


def test_single_row_has_a_single_value(table):
    df = table([("a", "r", 4.6, 4.0, "A")], SCORED)
    assert issues(df, "scored_results") == {("single_value", "score_accuracy"): 1}


def test_duplicate_ids_keep_all_rows_of_a_hot_id(table):
    rng = random.Random(1)
    ids = ["hot"] * 400 + [None] * 3 + [f"x{rng.randrange(600)}" for _ in range(500)] + ["once"]
    rows = list(enumerate(ids))
    got = {r.i for r in duplicate_ids(table(rows, "i int, prompt_id string")).collect()}
    assert got == {i for i, key in rows if ids.count(key) > 1}
    counts = {r.prompt_id: r.n for r in duplicated_keys(table(rows, "i int, prompt_id string")).collect()}
    assert counts["hot"] == 400 and counts[None] == 3 and "once" not in counts


def test_clean(table):
    schema = "prompt_id string, overall_score double, score_x double, grade string, note string"
    rows = [(" P1 ", 6.0, -2.0, "a", "n"), ("P1", 6.0, -2.0, "a", " n　"),
            ("P2", 5.0, None, " b", None), ("P2", 7.0, float("nan"), "b", None),
            ("P3", 1.0, 1.0, None, ""), ("P3", 1.0, 1.0, "z", "")]
    got = [tuple(r) for r in clean_results(table(rows, schema)).collect()]
    assert sorted(map(str, got)) == sorted(
        map(
            str,
            [("P1", 5.0, 0.0, "A", "n"), ("P2", 5.0, None, "B", None),
             # Clipped to the same score only after duplicates were dropped.
             ("P2", 5.0, float("nan"), "B", None), ("P3", 1.0, 1.0, "F", ""),
             ("P3", 1.0, 1.0, "F", "")],
        )
    )


@pytest.mark.parametrize(
    "kind, nest",
    [
        ("timestamp", lambda at: at),
        ("timestamp_ntz", lambda at: at),
        ("array<timestamp>", lambda at: [at, None]),
        ("struct<t: timestamp_ntz, n: int>", lambda at: (at, None)),
        ("map<string, array<timestamp>>", lambda at: {"k": [at]}),
        ("map<timestamp, int>", lambda at: {at: 1}),
    ],
)
def test_microseconds_tell_rows_apart(table, kind, nest):
    def value(micro):
        return nest(dt.datetime(2024, 5, 1, 12, 0, 0, micro))

    rows = [("P", value(123456)), ("P", value(123457)), (" P", value(123457)), ("P", None), ("P", None)]
    df = table(rows, f"prompt_id string, at {kind}")
    assert clean_results(df).count() == 3
    report = quality_report_columns(df.select("at")).collect()
    assert [r.unique_values for r in report] == [2]


def test_table_report(table, one):
    rows = [("x" * 100, 1.0)] * 3 + [("x" * 99, 1.0), (None, 0.0), (None, -0.0), ("=", None)]
    report = quality_report_table(table(rows, "a string, b double"))
    assert one(report) == {"total_rows": 7, "total_columns": 2, "duplicate_rows": 3}
    empty = quality_report_table(table([], "a string"))
    assert one(empty) == {"total_rows": 0, "total_columns": 1, "duplicate_rows": 0}


@pytest.mark.parametrize("approximate", [False, True])
def test_column_report(table, approximate):
    rng = random.Random(6)
    numbers = [rng.uniform(0, 10) for _ in range(200)]
    big = 2**60
    rows = [(v, big + i % 3, "t" * (i % 100), [i % 2], None) for i, v in enumerate(numbers)]
    rows += [(float("nan"), None, None, None, None), (None, big, "t", [0], None)]
    schema = "x double, b bigint, s string, l array<int>, n int"
    got = quality_report_columns(table(rows, schema), approximate).collect()
    report = {r["column"]: r for r in got}
    x = report["x"]
    assert (x.dtype, x.null_count, x.null_percentage) == ("double", 2, round(2 / 202 * 100, 2))
    assert x.mean == pytest.approx(statistics.mean(numbers))
    assert x["std"] == pytest.approx(statistics.stdev(numbers))
    assert (x["min"], x["max"]) == (min(numbers), max(numbers))
    if not approximate:
        assert x["median"] == pytest.approx(statistics.median(numbers))
        assert {c: r.unique_values for c, r in report.items()} == {
            "x": 200, "b": 3, "s": 100, "l": 2, "n": 0
        }
    nothing = report["n"]
    assert (nothing.null_count, nothing.mean, nothing["median"]) == (202, None, None)
    assert report["s"].mean is None


def test_column_report_of_empty_table(table, one):
    row = one(quality_report_columns(table([], "x double")))
    assert (row["null_count"], row["null_percentage"], row["unique_values"]) == (0, None, 0)
