from __future__ import annotations

import datetime
import random

import pytest
from pyspark.sql import functions as F

from respeval.operators import running
from respeval.operators.costs import cost_by_model, price_requests
from respeval.operators.quality import clean_results, duplicated_keys
from respeval.operators.rates import request_rate
from respeval.operators.running import budget_alerts
from respeval.operators.scoring import score_responses
from respeval.plans import catalog
from respeval.sources.results import save_responses, stream_results
from respeval.streaming import budget, streams, trailing
from tests.test_text import random_texts

USAGE = "run string, seq long, ts timestamp, model string, input_tokens long, output_tokens long"
START = datetime.datetime(2024, 1, 1)


def write_files(df, path, order, files):
    """One file per slice of the order, with rising modification times."""
    import os

    rows = df.count()
    size = -(-rows // files)
    for i in range(files):
        part = df.filter((F.col(order) >= i * size) & (F.col(order) < (i + 1) * size))
        part.coalesce(1).write.mode("append").parquet(path)
    names = sorted(
        (os.path.getmtime(f"{path}/{n}"), n) for n in os.listdir(path) if n.endswith(".parquet")
    )
    for i, (_, name) in enumerate(names):
        os.utime(f"{path}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))


@pytest.fixture
def usage(table):
    rng = random.Random(11)
    rows = [
        (rng.choice(["hot", "hot", "hot", "b", "c"]), i, START + datetime.timedelta(seconds=5 * i),
         rng.choice(["gpt-4", "claude-opus", "gpt-3.5"]), rng.randrange(3000), rng.randrange(3000))
        for i in range(600)
    ]
    return price_requests(table(rows, USAGE))


def read_stream(spark, df, path, **options):
    return spark.readStream.schema(df.schema).options(**options).parquet(path)


def test_scoring_a_stream_equals_the_table(spark, table, tmp_path):
    texts = [t for t in random_texts(120, seed=12)]
    df = table(list(enumerate(texts)), "i int, response string")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(df, path, "i", 3)
    scored = streams.score_stream(read_stream(spark, df, path, maxFilesPerTrigger=1))
    seen = []
    streams.run_available(
        scored, streams.persist_batches(out), str(tmp_path / "ck"), then=lambda b, i: seen.append(i)
    )
    stored = streams.read_persisted(spark, out, scored).collect()
    assert sorted(map(str, stored)) == sorted(map(str, score_responses(df).collect()))
    assert seen == [0, 1, 2]


def test_csv_folder_as_stream(spark, table, tmp_path):
    df = table([("a", "x\ny"), ("b", "z")], "prompt_id string, response string")
    save_responses(df, str(tmp_path / "in"))
    stream = stream_results(spark, str(tmp_path / "in"), df.schema, files_per_batch=1)
    streams.run_available(stream, streams.persist_batches(str(tmp_path / "o")), str(tmp_path / "ck"))
    rows = streams.read_persisted(spark, str(tmp_path / "o"), df).collect()
    assert sorted(map(tuple, rows)) == [("a", "x\ny"), ("b", "z")]


def test_restart_loses_and_doubles_nothing(spark, usage, tmp_path):
    path, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    write_files(usage, path, "seq", 4)
    store = streams.persist_batches(out)
    attempts = []

    def fail_once(batch, batch_id):
        store(batch, batch_id)
        attempts.append(batch_id)
        if attempts == [0, 1]:
            raise RuntimeError("lost after writing")

    stream = read_stream(spark, usage, path, maxFilesPerTrigger=1)
    with pytest.raises(Exception, match="lost after writing"):
        streams.run_available(stream, fail_once, checkpoint)
    streams.run_available(read_stream(spark, usage, path, maxFilesPerTrigger=1), fail_once, checkpoint)
    assert attempts == [0, 1, 1, 2, 3]
    rows = streams.read_persisted(spark, out, usage).collect()
    assert sorted(map(str, rows)) == sorted(map(str, usage.collect()))


@pytest.mark.parametrize("files", [1, 4])
def test_budget_stream_equals_the_table(spark, usage, tmp_path, files):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(usage, path, "seq", files)
    stream = read_stream(spark, usage, path, maxFilesPerTrigger=1)
    streams.run_available(stream, budget.budget_sink(out, 20.0, ["seq"]), str(tmp_path / "ck"))
    got = spark.read.parquet(f"{out}/alerts").select("run", "seq", "alert", "message").collect()
    expected = budget_alerts(usage, 20.0, ["seq"], ["run"]).select("run", "seq", "alert", "message")
    assert sorted(map(str, got)) == sorted(map(str, expected.collect()))
    assert {r.alert for r in got} == {"warning", "error"}


def test_budget_batch_run_again_replaces_itself(spark, usage, tmp_path):
    out = str(tmp_path / "out")
    sink = budget.budget_sink(out, 20.0, ["seq"])
    sink(usage.filter("seq < 300"), 0)
    sink(usage.filter("seq >= 300"), 1)
    first = sorted(map(str, spark.read.parquet(f"{out}/alerts").collect()))
    sink(usage.filter("seq >= 300"), 1)
    assert sorted(map(str, spark.read.parquet(f"{out}/alerts").collect())) == first


def test_null_costs_are_carried(spark, table, tmp_path):
    """A batch that begins with null costs goes on from what was spent before."""
    df = table(
        [("r", 0, 60.0), ("r", 1, None), ("r", 2, 1.0), ("n", 0, None), ("n", 3, None), ("n", 4, 45.0), (None, 4, 90.0)],
        "run string, seq long, cost double",
    ).withColumns({"input_tokens": F.lit(1), "output_tokens": F.lit(1)})
    out = str(tmp_path / "out")
    sink = budget.budget_sink(out, 50.0, ["seq"])
    for i, part in enumerate(("seq = 0", "seq in (1, 2)", "seq > 2")):
        sink(df.filter(part), i)
        sink(df.filter(part), i)
    got = spark.read.parquet(f"{out}/alerts").select("run", "seq", "alert", "message", "cumulative_cost").collect()
    expected = budget_alerts(df, 50.0, ["seq"], ["run"]).select("run", "seq", "alert", "message", "cumulative_cost")
    assert sorted(map(str, got)) == sorted(map(str, expected.collect()))
    assert {(r.run, r.seq) for r in got} == {("r", 0), ("r", 1), ("r", 2), ("n", 4), (None, 4)}


def test_budget_in_two_queries(spark, usage, tmp_path):
    """Usage of many batches first, with null costs, one of them lost after it was stored; then the state."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    usage = usage.withColumn("cost", F.when(F.col("seq") % 150 > 20, F.col("cost")))
    write_files(usage, path, "seq", 4)
    stored = budget.usage_sink(out, ["seq"])
    attempts = []

    def fail_once(batch, batch_id):
        stored(batch, batch_id)
        attempts.append(batch_id)
        if attempts == [0, 1]:
            raise RuntimeError("lost after writing")

    stream = read_stream(spark, usage, path, maxFilesPerTrigger=1)
    with pytest.raises(Exception, match="lost after writing"):
        streams.run_available(stream, fail_once, str(tmp_path / "ck"))
    budget.raise_alerts(spark, out, 20.0, usage.schema["run"].dataType)
    stream = read_stream(spark, usage, path, maxFilesPerTrigger=1)
    streams.run_available(stream, fail_once, str(tmp_path / "ck"))
    assert attempts == [0, 1, 1, 2, 3]
    for _ in range(2):
        budget.raise_alerts(spark, out, 20.0, usage.schema["run"].dataType)
    got = budget.read_alerts(usage, out).select("run", "seq", "alert", "message").collect()
    expected = budget_alerts(usage, 20.0, ["seq"], ["run"]).select("run", "seq", "alert", "message")
    assert sorted(map(str, got)) == sorted(map(str, expected.collect()))
    assert {r.alert for r in got} == {"warning", "error"}


def test_only_sums_reach_the_state(spark, usage, tmp_path):
    """Whatever a run's share of the usage, its state gets one row per batch."""
    out = str(tmp_path / "out")
    hot = usage.withColumn("run", F.lit("hot"))
    for i in range(3):
        budget.usage_sink(out, ["seq"])(hot.filter(F.col("seq") % 3 == i), i)
    sums = spark.read.parquet(f"{out}/sums")
    assert [tuple(r) for r in sums.select("run", "batch_id").orderBy("batch_id").collect()] == [("hot", i) for i in range(3)]
    # Rows of the one run are dealt over many slices.
    assert len(running.slice_table(hot, ["run", "seq"]).groupBy("__slice").count().collect()) > 8


def test_negative_budget():
    with pytest.raises(ValueError):
        budget.budget_sink("x", -1.0, ["seq"])


def test_usage_totals(spark, usage, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(usage, path, "seq", 3)
    totals = streams.usage_stream(read_stream(spark, usage, path, maxFilesPerTrigger=1))
    streams.run_totals(totals, out, str(tmp_path / "ck"))
    got = {r.model: r.cost for r in streams.read_latest(spark, out, totals).collect()}
    expected = {r.model: r.cost for r in cost_by_model(usage).collect()}
    assert got == pytest.approx(expected)


def test_closed_windows_equal_counts(spark, usage, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(usage, path, "seq", 1)
    rate = streams.rate_stream(read_stream(spark, usage, path), "ts", ["run"], 30)
    streams.run_available(rate, streams.persist_batches(out), str(tmp_path / "ck"))
    got = {(r.run, r.window_start): r.calls
           for r in streams.read_persisted(spark, out, rate).collect()}
    rows = usage.collect()
    mark = max(r.ts for r in rows) - datetime.timedelta(minutes=2)
    minute = datetime.timedelta(minutes=1)
    expected = {}
    for r in rows:
        first = r.ts - datetime.timedelta(seconds=r.ts.second % 10)
        for i in range(6):
            start = first - i * datetime.timedelta(seconds=10)
            if start + minute <= mark:
                expected[(r.run, start)] = expected.get((r.run, start), 0) + 1
    assert got == expected


@pytest.mark.parametrize(("files", "span"), [(1, 60), (5, 60), (4, 1), (5, 7)])
def test_trailing_minutes_equal_the_table(spark, table, tmp_path, monkeypatch, files, span):
    """Exact rates of all instants of closed minutes; requests of one instant, null keys and times, late rows."""
    monkeypatch.setattr(trailing, "SPAN", span)
    rng = random.Random(21)
    rows, at = [], START
    for i in range(900):
        at += datetime.timedelta(microseconds=rng.choice([0, 1, 250_000, 999_999, 3_000_000, 20_000_000]))
        shown = at - datetime.timedelta(seconds=rng.choice([0, 0, 0, 50]))  # up to 50 seconds late
        rows.append((rng.choice(["hot", "hot", "b", None]), i, None if i % 97 == 0 else shown))
    df = table(rows, "run string, seq long, ts timestamp")
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(df, path, "seq", files)
    stream = read_stream(spark, df, path, maxFilesPerTrigger=1)
    rate = trailing.trailing_minute_stream(stream, "ts", ["run"], 30, "60 seconds")
    streams.run_available(rate, streams.persist_batches(out), str(tmp_path / "ck"))
    got = streams.read_persisted(spark, out, rate)
    mark = max(r[2] for r in rows if r[2]) - datetime.timedelta(minutes=1)
    closed = F.date_trunc("minute", "ts") + F.expr("INTERVAL 1 MINUTE") <= F.lit(mark)
    expected = request_rate(df, "ts", ["run"], 30).filter(closed)
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.select(*got.columns).collect()))
    assert got.count() > 300


def dirty(table):
    rng = random.Random(31)
    rows = []
    for i in range(400):
        k = rng.randrange(150)
        rows.append((rng.choice(["", " "]) + f"p{k}", f"text {k}", float(k % 9) - 1, rng.choice(["a", "x", None]), i))
    schema = "prompt_id string, response string, overall_score double, grade string, i int"
    return table(rows, schema).withColumn("at", F.timestamp_seconds(F.col("i")))


def test_copies_in_later_batches_are_dropped(spark, table, tmp_path):
    df = dirty(table)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(df, path, "i", 5)
    stream = read_stream(spark, df, path, maxFilesPerTrigger=1)
    clean = streams.clean_stream(stream, "at", "1 hour", ignore=["at", "i"])
    streams.run_available(clean, streams.persist_batches(out), str(tmp_path / "ck"))
    got = streams.read_persisted(spark, out, clean)
    expected = clean_results(df.drop("at", "i"))
    assert got.columns == df.columns and got.count() < 400
    assert sorted(map(str, got.drop("at", "i").collect())) == sorted(map(str, expected.collect()))


def test_state_of_copies_is_bounded(spark, table, tmp_path):
    """Digests older than the watermark are dropped from the state; copies of such rows stay."""
    rows = [(f"p{i % 60}", float(i % 60), i) for i in range(600)]
    df = table(rows, "prompt_id string, overall_score double, i int").withColumn("at", F.timestamp_seconds(F.col("i") * 10))
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(df, path, "i", 6)
    stream = read_stream(spark, df, path, maxFilesPerTrigger=1)
    clean = streams.clean_stream(stream, "at", "100 seconds", ignore=["at", "i"])
    query = streams.run_available(clean, streams.persist_batches(out), str(tmp_path / "ck"))
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] <= 120
    assert streams.read_persisted(spark, out, clean).count() > 60


def test_repeated_ids_over_batches(spark, table, tmp_path):
    df = dirty(table)
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    write_files(df, path, "i", 4)
    stream = read_stream(spark, df, path, maxFilesPerTrigger=1)
    repeated = streams.repeated_id_stream(stream, "at", "prompt_id", "1 day")
    streams.run_updates(repeated, out, str(tmp_path / "ck"))
    last = streams.read_persisted(spark, out, repeated).groupBy("prompt_id").agg(F.max("n").alias("n"))
    assert sorted(map(str, last.collect())) == sorted(map(str, duplicated_keys(df).collect()))


def test_arrivals_are_written_by_many_tasks(spark, tmp_path):
    """Three parts, each with a file per task that read the table, and a run after each that sees only its part."""
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.range(0, 600, 1, 4).select(F.col("id").alias("doc_id"), (F.col("id") % 250).cast("string").alias("prompt_id"))
    files = []

    def run(arrived):
        files.append(len(spark.read.parquet(path).inputFiles()))
        return streams.run_available(arrived, streams.persist_batches(out), str(tmp_path / "ck"))

    catalog._arrivals(spark, path, df, run)
    assert files == [4, 8, 12]
    stored = spark.read.parquet(out).groupBy("batch_id").agg(F.count("*"), F.count_distinct(F.col("doc_id") % 3), F.min("at"))
    assert [(n, kinds) for _, n, kinds, _ in sorted(stored.collect())] == [(200, 1)] * 3
    assert spark.read.parquet(out).select("doc_id", "prompt_id").exceptAll(df).count() == 0


def test_repeated_ids_of_a_table_of_many_files(spark, tmp_path, monkeypatch):
    """The query's counts, of copies within a part and over parts; no task takes a part, or the table, alone."""
    rows = [(i, f"text {i % 170}" if i % 7 else None, "en", "src1", 9) for i in range(480)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(catalog, "work_path", lambda spark, name: str(tmp_path / "work" / name))
    got = catalog.stream_repeated_ids(spark, str(tmp_path))
    expected = docs.groupBy(F.md5("text").alias("prompt_id")).agg(F.count("*").alias("n")).filter("n > 1")
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))
    names = [str(f) for f in (tmp_path / "work").rglob("*.parquet") if f.is_file()]
    assert len([f for f in names if "batch_id=" not in f]) == 12


def test_streamed_csv_has_files_of_bounded_size(spark, tmp_path, monkeypatch):
    """More files for a larger table, still in two batches; records with line breaks, quotes and nulls are whole."""
    rows = [(i, f'line {i}\n"quoted", {"x" * 300}' if i % 9 else None, "en", f"src{i % 4}", i) for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(catalog, "work_path", lambda spark, name: str(tmp_path / "work" / name))
    monkeypatch.setattr(catalog.io, "FILE_BYTES", 20_000, raising=False)
    got = catalog.QUERIES["stream_csv"](spark, str(tmp_path))
    assert sorted(map(str, got.select(*docs.columns).collect())) == sorted(map(str, docs.collect()))
    written = [f for f in (tmp_path / "work").rglob("*.csv") if f.is_file()]
    assert len(written) >= 13 and max(f.stat().st_size for f in written) < 30_000
    batches = {f.parent.name for f in (tmp_path / "work").rglob("*.parquet") if f.is_file()}
    assert batches == {"batch_id=0", "batch_id=1"}
