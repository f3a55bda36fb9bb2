"""Every registered query against its DuckDB form, and what the data must exercise."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from respeval.plans.catalog import QUERIES
from respeval.plans.oracles import ORACLES
from tests.check import connect, differences

SMALL = "/root/testdata/sf0.001"
MEDIUM = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    found, _ = differences(spark, duck, name, SMALL)
    assert found == []


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() == 7


def test_all_levels_occur(spark):
    """A check on data that never fires a rule would prove nothing."""
    scored = entry.queries()["score_responses"](spark, MEDIUM).collect()
    for dimension in ("accuracy", "reasoning", "tone", "completeness"):
        assert {r[dimension] for r in scored} == {1.0, 2.0, 3.0, 4.0, 5.0}, dimension
    codes = {code for r in scored for code in r.defects.split(",") if code}
    assert codes == {f"D0{i}" for i in range(1, 8)}
    grades = entry.queries()["assign_grade"](spark, MEDIUM)
    assert {r.grade for r in grades.collect()} >= {"A", "B", "C", "F"}
    alerts = entry.queries()["budget_alerts"](spark, MEDIUM)
    assert {r.alert for r in alerts.collect()} == {"warning", "error"}
    statuses = {r.status for r in entry.queries()["regression_report"](spark, MEDIUM).collect()}
    assert statuses == {"regression", "improvement", "stable"}
    calls = entry.queries()["request_rate"](spark, MEDIUM).collect()
    assert {r.calls_last_minute for r in calls} >= {1, 2, 3}
