from __future__ import annotations

import csv
import glob
import json
import os
from types import SimpleNamespace

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from respeval import schemas
from respeval.operators.costs import price_requests
from respeval.plans.workflows import (
    REPORTS,
    check_run,
    evaluate,
    score_results,
    track_execution,
    write_reports,
)
from respeval.sources import results as io
from respeval.sources import storage
from respeval.sources.storage import remove, shared_folder, write_and_read

ROWS = [("a", 'say "hi",\nthen <go>', 1.5, ["D01", "D02"]), ("b", None, None, []),
        ("c", "é; \\n", 2.0, None)]
SCHEMA = "prompt_id string, response string, score double, defects array<string>"


def test_csv_round_trip(spark, table, tmp_path):
    path = str(tmp_path / "out")
    io.save_responses(table(ROWS, SCHEMA), path)
    text = io.load_results(spark, path)
    assert text.columns == ["defects", "prompt_id", "response", "score"]
    assert {t for _, t in text.dtypes} == {"string"}
    typed = io.load_typed_results(spark, path, "defects string, prompt_id string, response string, score double")
    got = {r.prompt_id: (r.response, r.score, r.defects) for r in typed.collect()}
    assert got["a"] == ('say "hi",\nthen <go>', 1.5, "D01,D02")
    assert got["c"] == ("é; \\n", 2.0, None)


def test_csv_written_by_python(spark, tmp_path):
    rows = [
        ("a", "two\nlines, \"quoted\" and \\ kept ", "1.5"),
        ("b", "\nstarts with a break", ""),
        ("c", "", "nan"),
    ]
    with open(tmp_path / "r.csv", "w", newline="", encoding="utf-8") as f:
        writer = csv.writer(f)
        writer.writerow(["prompt_id", "response", "score"])
        writer.writerows(rows)
    back = io.load_results(spark, str(tmp_path / "r.csv")).collect()
    assert [tuple(v or "" for v in r) for r in back] == rows
    schema = "prompt_id string, response string, score double"
    typed = io.load_typed_results(spark, str(tmp_path / "r.csv"), schema).collect()
    assert (typed[0].score, typed[1].score) == (1.5, None)


def test_nested_values_in_csv(spark, table, tmp_path):
    df = table([(("x", 1), {"k": 2})], "s struct<a: string, b: int>, m map<string, int>")
    io.save_responses(df, str(tmp_path / "out"))
    (row,) = io.load_results(spark, str(tmp_path / "out")).collect()
    assert (json.loads(row.s), json.loads(row.m)) == ({"a": "x", "b": 1}, {"k": 2})


@pytest.mark.parametrize("fmt", ["json", "parquet"])
def test_other_formats(spark, table, tmp_path, fmt):
    path = str(tmp_path / "out")
    io.save_responses(table(ROWS, SCHEMA), path, fmt)
    back = spark.read.schema(SCHEMA).format(fmt).load(path)
    assert sorted(map(str, back.collect())) == sorted(map(str, table(ROWS, SCHEMA).collect()))


def test_unknown_format_and_missing_file(spark, table, tmp_path):
    with pytest.raises(ValueError):
        io.save_responses(table(ROWS, SCHEMA), str(tmp_path / "x"), "xml")
    with pytest.raises(AnalysisException):
        io.load_results(spark, str(tmp_path / "nothing"))
    with pytest.raises(ValueError):
        io.save_scores(table(ROWS, SCHEMA), "")


def test_no_rows_no_file(table, tmp_path):
    io.save_scores(table([], SCHEMA), str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()
    io.save_scores(table(ROWS, SCHEMA), str(tmp_path / "x"))
    assert (tmp_path / "x").exists()


def test_usage_log(spark, table, tmp_path):
    usage = price_requests(
        table([("p", "gpt-4", 10, 5)], "prompt_id string, model string, input_tokens long, output_tokens long")
    )
    io.export_usage_log(usage, str(tmp_path / "log"), 1.0)
    summary = spark.read.json(str(tmp_path / "log" / "summary")).collect()[0]
    assert (summary.total_requests, summary.total_tokens) == (1, 15)
    log = spark.read.json(str(tmp_path / "log" / "usage_log")).collect()[0]
    assert (log.model, log.cost) == ("gpt-4", 0.0006)


def test_shared_folder_comes_from_the_session(spark, tmp_path):
    before = spark.conf.get("spark.checkpoint.dir", None)
    assert before is None or shared_folder(spark) == before.rstrip("/")
    assert shared_folder(spark) == shared_folder(spark)
    df = write_and_read(spark.range(10), "t")
    assert df.count() == 10
    assert df.inputFiles()


def test_removed_folders_are_gone(spark, tmp_path):
    spark.range(3).write.parquet(f"file://{tmp_path}/t")
    remove(spark, f"file://{tmp_path}/t")
    remove(spark, f"file://{tmp_path}/t")
    assert not os.path.exists(tmp_path / "t")


def test_no_local_folder_on_a_cluster():
    def session(master, conf=None, context=None):
        return SimpleNamespace(
            conf=SimpleNamespace(get=lambda name, default: conf or default),
            sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: context),
        )

    assert shared_folder(session("yarn", conf="hdfs:///shared/")) == "hdfs:///shared"
    assert shared_folder(session("yarn", context="hdfs:///set")) == "hdfs:///set"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session("spark://host:7077"))


def test_only_a_small_side_is_broadcast(table):
    side = table([("k", "x" * 50), ("l", None), (None, "é")], "k string, v string")
    long = table([("k", 1)] * 300 + [("m", 2), (None, 3)], "k string, n int")
    plans = {}
    for bounds in ((10, 1000), (2, 1000), (10, 20)):
        joined = long.join(storage.broadcast_if_small(side, *bounds), "k", "left")
        plans[bounds] = joined._jdf.queryExecution().optimizedPlan().toString()
        assert joined.filter("v IS NOT NULL").count() == 300
        assert joined.count() == 302
    assert ["strategy=broadcast" in p for p in plans.values()] == [True, False, False]


def test_evaluate_and_check(spark, tmp_path):
    texts = [f"Explain topic number {i} in detail." for i in range(8)]
    content = {
        "metadata": {"version": "1", "description": "d"},
        "prompts": [{"id": f"p{i}", "category": "c", "text": t} for i, t in enumerate(texts)],
    }
    (tmp_path / "prompts").mkdir()
    (tmp_path / "prompts" / "p.json").write_text(json.dumps(content))

    def model(text: str) -> str:
        if "number 7" in text:
            raise TimeoutError("slow")
        return "Because of this, certainly: " + text

    out = str(tmp_path / "out")
    scored = evaluate(spark, str(tmp_path / "prompts"), model, out)
    rows = scored.collect()
    assert len(rows) == 7
    assert {round(r.overall_score, 6) for r in rows} == {round(5 * (0.8 * 0.4 + 0.6 * 0.3 + 0.8 * 0.15 + 0.6 * 0.15), 6)}
    assert all(r.cost > 0 for r in rows)
    (stats,) = spark.read.json(f"{out}/reports/statistics").collect()
    assert stats.total_evaluations == 7
    assert len(glob.glob(f"{out}/reports/*")) == 6

    tracked = track_execution(spark.read.parquet(f"{out}/raw"), 1.0)
    (summary,) = tracked["summary"].collect()
    assert (summary.total, summary.failed) == (8, 1)
    assert [r.error_type for r in tracked["failed"].collect()] == ["TimeoutError"]
    assert tracked["costs"].collect()[0].total_requests == 7

    baseline = str(tmp_path / "baseline")
    report, verdict = check_run(spark, scored, baseline, update_baseline=True)
    assert verdict.collect()[0].reason == "No baseline available"
    report, verdict = check_run(spark, scored, baseline)
    assert {r.status for r in report.collect()} == {"stable"}
    assert verdict.collect()[0].has_regression is False


def test_score_results_keeps_successes(table):
    df = table([("a", "x", "success"), ("b", "y", "error")], "prompt_id string, response string, status string")
    assert [r.prompt_id for r in score_results(df).collect()] == ["a"]


def test_one_failing_report_does_not_stop_the_others(table, tmp_path):
    df = table([("a", 3.0, 5)], "prompt_id string, overall_score double, defects int")
    with pytest.warns(UserWarning, match="defect_summary"):
        written = write_reports(df, str(tmp_path / "r"))
    assert "defect_summary" not in written
    assert {"statistics", "executive_summary"} <= set(written)


def test_schemas_name_the_stored_columns():
    assert schemas.RAW_RESULTS.names[:3] == ["prompt_id", "prompt", "response"]
    assert schemas.PROMPT_FILE["prompts"].dataType.elementType == schemas.PROMPT


def test_reports_score_a_table_once(spark, tmp_path):
    """A table that is scored as it is read is scored once for all reports, and its texts are not stored."""
    calls = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(i):
        calls.add(1)
        return i % 5 + 0.5

    named = [F.col("id").cast("string").alias("prompt_id"), F.lit("D01, D02").alias("defects")]
    df = spark.range(0, 40, 1, 2).select(*named, score("id").alias("overall_score"))
    written = write_reports(df, str(tmp_path / "r"))
    assert set(written) == set(REPORTS) and calls.value == 40
    (stats,) = spark.read.json(written["statistics"]).collect()
    assert (stats.total_evaluations, stats.mean_overall) == (40, 2.5)
    assert {(r.defect, r["count"]) for r in spark.read.json(written["defect_summary"]).collect()} == {("D01", 40), ("D02", 40)}


def test_reports_of_a_table_that_cannot_be_stored(table, tmp_path):
    """A column that fails stops only the reports that read it."""
    df = table([("a", 3.0)], "prompt_id string, overall_score double")
    df = df.withColumn("defects", F.when(F.col("overall_score") < 9, F.raise_error(F.lit("no defects"))).cast("string"))
    with pytest.warns(UserWarning, match="defect_summary"):
        written = write_reports(df, str(tmp_path / "r"))
    assert set(written) == set(REPORTS) - {"defect_summary"}
