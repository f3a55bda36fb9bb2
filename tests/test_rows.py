"""Prompts, execution, sanitising, union."""

from __future__ import annotations

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from respeval.functions.sanitize import (
    html_escape,
    sanitize_filename,
    sanitize_string,
    sanitize_value,
    valid_key_shape,
)
from respeval.operators.execute import (
    error_stats,
    execute_prompts,
    failed_requests,
    filter_success,
    map_chunks,
)
from respeval.operators.prompts import lint_prompt_files, lint_prompts, pending_prompts
from respeval.operators.tables import ragged_union
from respeval.sources.prompts import load_prompt_files, load_prompts


@pytest.fixture
def prompt_folder(tmp_path):
    good = {
        "metadata": {"version": "1", "description": "d"},
        "prompts": [
            {"id": "a-1", "category": "c", "text": "Explain how a bridge carries load."},
            {"id": "a-1", "category": "c", "text": "Explain tides.", "difficulty": "mad"},
            {"id": "b 2", "category": "c", "text": "Short",
             "expected_criteria": {"min_tokens": 9, "max_tokens": 5}},
            {"id": "d", "category": "c", "text": "Explain how a bridge carries load.",
             "expected_criteria": {"min_tokens": 9, "max_tokens": 0}},
            {"prompt": "only a prompt field here"},
        ],
    }
    (tmp_path / "good.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "empty.json").write_text('\n {"metadata": {"version": "1"}, "prompts": []}')
    return tmp_path


def test_load_and_lint(spark, prompt_folder):
    rows = lint_prompts(load_prompts(spark, str(prompt_folder))).collect()
    assert sorted(r.issues for r in rows) == sorted(
        [
            ["duplicate_id"],
            ["bad_difficulty", "text_very_short", "duplicate_id"],
            ["bad_id", "text_too_short", "text_very_short", "min_tokens_over_max"],
            [],
            ["missing_id", "missing_category", "missing_text", "text_very_short"],
        ]
    )


def test_lint_files(spark, prompt_folder):
    files = lint_prompt_files(load_prompt_files(spark, str(prompt_folder))).collect()
    found = {r.file.rsplit("/", 1)[1]: r.issues for r in files}
    assert found == {"good.json": [], "empty.json": ["missing_description", "no_prompts"]}


def test_prompt_file_must_hold_an_object(spark, tmp_path):
    (tmp_path / "list.json").write_text('[{"id": "a"}]')
    with pytest.raises(Exception, match="must hold a JSON object"):
        load_prompts(spark, str(tmp_path)).collect()


def test_lint_without_optional_columns(table):
    (row,) = lint_prompts(table([("x",)], "category string")).collect()
    assert row.issues == ["missing_id", "missing_text", "no_prompt_text", "text_very_short"]


def test_pending(table):
    asked = table([("a",), ("b",), ("c",)], "prompt_id string")
    done = table([("b",)] * 50 + [(None,)], "prompt_id string")
    assert {r.prompt_id for r in pending_prompts(asked, done).collect()} == {"a", "c"}


def test_execute_isolates_errors(spark, table):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        asked = table(
            [("1", "p", "t"), ("", None, "x"), (None, "", "z"), ("4", None, None), ("5", "x", "")],
            "id string, prompt string, text string",
        )

        def fn(text: str) -> str:
            if text == "x":
                raise KeyError("no x")
            return text.upper()

        results = execute_prompts(asked, fn, "m", concurrency=3)
        rows = sorted((r.prompt_id, r.prompt, r.response, r.status, r.error) for r in results.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert rows == [
        ("1", "p", "P", "success", None),
        ("4", "", "", "success", None),
        ("5", "x", "", "error", "'no x'"),
        ("unknown", "x", "", "error", "'no x'"),
        ("unknown", "z", "Z", "success", None),
    ]
    failed = failed_requests(results).collect()
    assert {(r.error_type, r.severity) for r in failed} == {("KeyError", "low")}
    assert filter_success(results).count() == 3


def test_execute_needs_a_prompt_column(table):
    with pytest.raises(ValueError):
        execute_prompts(table([("a",)], "id string"), str.upper)


def test_filter_success_drops_null_status(table):
    df = table([("success",), ("error",), (None,)], "status string")
    assert filter_success(df).count() == 1
    assert filter_success(df.withColumnRenamed("status", "s")).count() == 3


def test_map_chunks(spark, table):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        def double(chunk: pd.DataFrame) -> pd.DataFrame:
            assert len(chunk) <= 3
            return chunk.assign(x=chunk["x"] * 2)

        out = map_chunks(table([(i,) for i in range(20)], "x long"), double, "x long")
        assert sorted(r.x for r in out.collect()) == [2 * i for i in range(20)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_error_stats(table):
    types = ["TimeoutError", "TimeoutError", "RateLimitError", "InvalidConfigError", "Odd",
             "ValueError", None]
    got = {(r.dimension, r.value): r["count"]
           for r in error_stats(table([(t,) for t in types], "error_type string")).collect()}
    assert got == {
        ("error_type", "TimeoutError"): 2, ("error_type", "RateLimitError"): 1,
        ("error_type", "InvalidConfigError"): 1, ("error_type", "Odd"): 1,
        ("error_type", "ValueError"): 1, ("error_type", None): 1,
        ("severity", "critical"): 1, ("severity", "high"): 3, ("severity", "medium"): 1,
        ("severity", "low"): 2,
    }


@pytest.mark.parametrize(
    ("text", "clean"),
    [("  Hello   World  ", "Hello World"), ("a\x00b", "ab"), ("a\x00 \x00b", "a b"), ("", ""),
     ("x" * 10_005, "x" * 10_000), (" " * 10_000 + "x", "")],
)
def test_sanitize_string(table, one, text, clean):
    df = table([(text,)], "t string").select(sanitize_string(F.col("t")).alias("c"))
    assert one(df)["c"] == clean


@pytest.mark.parametrize(
    ("name", "safe"),
    [("../../etc/passwd", "etcpasswd"), ("///", "unnamed_file"), ("", "unnamed_file"),
     ("é x-1_2.txt ", "é x-1_2.txt"), ("a" * 300, "a" * 255), ("..a/.b..", "a.b")],
)
def test_sanitize_filename(table, one, name, safe):
    df = table([(name,)], "t string").select(sanitize_filename(F.col("t")).alias("c"))
    assert one(df)["c"] == safe


def test_sanitize_nested(table, one):
    schema = ("v struct<`a  b`: string, n: int, l: array<struct<s: string>>, "
              "m: map<string, array<string>>, k: map<int, string>>")
    value = (" x ", 1, [(" y  z",), None], {" k ": [" 1"], "k": ["2 "]}, {1: " q "})
    df = table([(value,), (None,)], schema)
    cleaned = df.select(sanitize_value(F.col("v"), df.schema["v"].dataType).alias("v"))
    first, second = (r.asDict(recursive=True)["v"] for r in cleaned.collect())
    assert second is None
    assert first == {"a b": "x", "n": 1, "l": [{"s": "y z"}, None], "m": {"k": ["2"]}, "k": {1: "q"}}


@pytest.mark.parametrize(
    ("key", "valid"),
    [("sk-" + "a" * 40, True), ("short", False), ("a" * 35, True), ("a" * 30, False),
     ("sk-" + "a" * 17, True), ("sk-" + "a" * 16, False), ("claude-" + "a" * 13, True),
     ("", False), (None, False)],
)
def test_key_shape(table, one, key, valid):
    df = table([(key,)], "t string").select(valid_key_shape(F.col("t")).alias("v"))
    assert one(df)["v"] is valid


def test_html_escape(table, one):
    import html

    text = "<a href=\"x\">'&amp;'</a>"
    df = table([(text,)], "t string").select(html_escape(F.col("t")).alias("e"))
    assert one(df)["e"] == html.escape(text)


def test_ragged_union(table):
    union = ragged_union(table([(1, "x")], "b int, a string"), table([(2.0,)], "c double"))
    assert union.columns == ["a", "b", "c"]
    assert [tuple(r) for r in union.collect()] == [("x", 1, None), (None, None, 2.0)]
