"""Broken records, and tables in buckets."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from respeval.operators.prompts import pending_prompts
from respeval.operators.quality import duplicate_ids
from respeval.sources import bucketed, checked
from respeval.streaming import streams

SCHEMA = "prompt_id string, response string, score double, n int"
GOOD = [("a", 'two\nlines, "quoted"', 1.5, 1), ("b", "", None, None), ("c", "x", 2.0, 3)]
CSV = (
    'prompt_id,response,score,n\n'
    'a,"two\nlines, ""quoted""",1.5,1\n'
    'bad,text,high,2\n'
    'b,,,\n'
    'short,only two\n'
    'long,x,1.0,2,more\n'
    'late,x,1.0,2.5\n'
    'c,x,2.0,3\n'
)
REASONS = {
    "bad,text,high,2": "score is no double: high",
    "short,only two": "2 of 4 fields",
    "long,x,1.0,2,more": "more than 4 fields",
    "late,x,1.0,2.5": "n is no int: 2.5",
}


def good(df):
    return sorted(((r.prompt_id, r.response or "", r.score, r.n) for r in df.collect()))


def test_broken_csv_records(spark, tmp_path):
    (tmp_path / "r.csv").write_text(CSV)
    df = checked.read_checked(spark, str(tmp_path / "r.csv"), SCHEMA)
    rows = checked.good_rows(df)
    assert good(rows) == GOOD and rows.columns == ["prompt_id", "response", "score", "n"]
    assert rows.select("prompt_id").count() == 3  # whatever is selected
    got = checked.rejects(df).collect()
    assert {r.text.strip(): r.reason for r in got} == REASONS
    assert all(r.file.endswith("/r.csv") for r in got)


def test_broken_json_records(spark, tmp_path):
    lines = [json.dumps(dict(zip(("prompt_id", "response", "score", "n"), r, strict=True))) for r in GOOD]
    broken = {'{"prompt_id": "x", "score": ': "no JSON", "plain text": "no JSON", '{"prompt_id": "y", "score": "high"}': "a field of another type"}
    (tmp_path / "r.json").write_text("\n".join([lines[0], *broken, *lines[1:]]) + "\n")
    df = checked.read_checked(spark, str(tmp_path), SCHEMA, "json")
    assert good(checked.good_rows(df)) == GOOD
    assert {r.text: r.reason for r in checked.rejects(df, "json").collect()} == broken


@pytest.mark.parametrize("multi_line", [True, False])
def test_broken_records_in_a_stream(spark, tmp_path, multi_line):
    text = CSV if multi_line else CSV.replace("two\nlines", "two lines")
    for i in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{i}.csv").write_text(text.replace("a,", f"a{i},", 1))
    stream = checked.stream_checked(spark, str(tmp_path / "in"), SCHEMA, multi_line=multi_line, files_per_batch=1)
    out = str(tmp_path / "out")
    streams.run_available(stream, checked.checked_sink(out), str(tmp_path / "ck"))
    stored = spark.read.parquet(f"{out}/good")
    assert stored.count() == 9 and stored.select("batch_id").distinct().count() == 3
    bad = spark.read.parquet(f"{out}/rejects").collect()
    assert sorted(r.reason for r in bad) == sorted([*REASONS.values()] * 3)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_move_nothing(spark, tmp_path):
    """More ids than a broadcast may hold, on both sides."""
    ids = spark.range(1_200_000).select(F.concat(F.lit("p"), F.col("id")).alias("prompt_id"), "id")
    bucketed.save_bucketed(ids, "asked", str(tmp_path / "asked"), buckets=8)
    bucketed.save_bucketed(ids.filter("id % 100 > 0"), "done", str(tmp_path / "done"), buckets=8)
    asked, done = (bucketed.load_bucketed(spark, n) for n in ("asked", "done"))
    pending = bucketed.pending_in_buckets(asked, done)
    assert "Exchange" not in plan(pending) and pending.count() == 12_000
    again = bucketed.repeated_in_buckets(done)
    assert plan(again).count("Exchange") <= 2  # of the one row that counts nulls
    assert "hashpartitioning" not in plan(again) and again.count() == 0
    bucketed.save_bucketed(ids.filter("id < 50"), "done", str(tmp_path / "done"), buckets=8, mode="append")
    later = bucketed.load_bucketed(spark, "done")
    assert bucketed.pending_in_buckets(asked, later).count() == 11_999
    assert bucketed.repeated_in_buckets(later).count() == 98
    for name in ("asked", "done"):
        spark.sql(f"DROP TABLE {name}")


def test_buckets_equal_the_other_ways(spark, table, tmp_path):
    rows = [(k, i) for i, k in enumerate(["a", "a", None, "b", None, "c", "c", "c", "", "d"])]
    df = table(rows, "prompt_id string, i int")
    bucketed.save_bucketed(df, "some_rows", str(tmp_path / "t"), buckets=4)
    kept = bucketed.load_bucketed(spark, "some_rows")
    done = table([("b",), ("d",), (None,)], "prompt_id string")
    for a, b in (
        (bucketed.pending_in_buckets(kept, done), pending_prompts(df, done)),
        (bucketed.repeated_in_buckets(kept), duplicate_ids(df)),
        (bucketed.repeated_in_buckets(kept.filter("i < 4")), duplicate_ids(df.filter("i < 4"))),
    ):
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    spark.sql("DROP TABLE some_rows")
