from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from respeval.functions.cost import PRICES, normalize_model
from respeval.operators.costs import cost_by_model, cost_summary, price_requests, row_cost
from respeval.operators.running import (
    SLICE,
    SLICES,
    budget_alerts,
    budget_status,
    cumulative_cost,
    exact_medians,
    running_sum,
    slice_table,
)

USAGE = "run string, seq long, model string, input_tokens long, output_tokens long"


@pytest.mark.parametrize(
    ("name", "key"),
    [("claude-3-sonnet-20240229", "claude-sonnet-4-6"), ("gpt-3.5-turbo-0125", "gpt-3.5-turbo"),
     ("GPT-35", "gpt-3.5-turbo"), ("gpt-4-turbo", "gpt-4-turbo-preview"), ("gpt-4o", "gpt-4"),
     ("Claude-Opus", "claude-opus-4-6"), ("x-haiku", "claude-haiku-4-5-20251001"),
     ("Mystery", "Mystery")],
)
def test_model_names(table, one, name, key):
    df = table([(name,)], "m string").select(normalize_model(F.col("m")).alias("k"))
    assert one(df)["k"] == key


def test_unknown_model_pays_default(table, one):
    df = table([("a", 1, "mystery", 1_000_000, 1_000_000)], USAGE)
    assert one(price_requests(df))["cost"] == pytest.approx(90.0)


def test_price_table_gives_the_same_costs(spark, table):
    rows = [("r", i, m, 1000 + i, 10 * i) for i, m in enumerate([*PRICES, "mystery", None])]
    df = table(rows, USAGE)
    prices = table(
        [(k, i, o) for k, (i, o) in PRICES.items()],
        "price_key string, input_price double, output_price double",
    )
    def costs(priced):
        return {r.seq: r.cost for r in priced.collect()}

    assert costs(price_requests(df, prices)) == costs(price_requests(df))


def test_row_tokens(table):
    rows = [("20", 30.5, "abcdefgh", "x"), ("nan", float("nan"), "abcdefgh", "abcd" * 3),
            (None, float("inf"), None, "x"), ("bad", None, "x", "")]
    df = table(rows, "prompt_tokens string, response_tokens double, prompt string, response string")
    got = [(r.input_tokens, r.output_tokens) for r in row_cost(df).collect()]
    assert got == [(20, 30), (0, 3), (0, 0), (0, 0)]


def test_own_token_counter(table, one):
    df = table([("abc", "de")], "prompt string, response string")
    priced = row_cost(df, counter=lambda text: F.length(text))
    assert (one(priced)["input_tokens"], one(priced)["output_tokens"]) == (3, 2)


def test_cost_summary(table, one):
    priced = price_requests(
        table([("r", 1, "gpt-4", 100_000, 100_000), ("r", 2, "gpt-4", 0, 0)], USAGE)
    )
    row = one(cost_summary(priced, 10.0))
    assert row["total_requests"] == 2
    assert row["total_tokens"] == 200_000
    assert row["total_cost"] == 9.0
    assert row["avg_tokens_per_request"] == 100_000
    assert row["average_cost_per_call"] == 4.5
    assert (row["budget_remaining"], row["budget_utilized_percent"]) == (1.0, 90.0)
    free = one(cost_summary(priced))
    assert (free["budget_remaining"], free["budget_utilized_percent"]) == (None, 0.0)
    nothing = one(cost_summary(priced.filter("seq > 5")))
    assert (nothing["total_requests"], nothing["average_cost_per_call"]) == (0, 0.0)


def test_cost_by_model_sums_rounded_costs(table):
    rng = random.Random(1)
    rows = [("r", i, "gpt-3.5-turbo", rng.randrange(50), rng.randrange(50)) for i in range(300)]
    (got,) = cost_by_model(price_requests(table(rows, USAGE))).collect()
    expected = sum(round(i / 1e6 * 0.5 + o / 1e6 * 1.5, 6) for _, _, _, i, o in rows)
    assert got.cost == pytest.approx(expected, abs=1e-12)


def test_alerts(table, one):
    first = price_requests(table([("r", 1, "gpt-4", 100_000, 100_000)], USAGE))
    row = one(budget_alerts(first, 10.0, ["seq"]))
    assert row["alert"] == "warning"
    assert row["message"] == "Budget warning: $1.0000 remaining (80% spent)"
    big = price_requests(table([("r", 1, "gpt-4", 500_000, 500_000)], USAGE))
    row = one(budget_alerts(big, 1.0, ["seq"]))
    assert row["message"] == "Budget exceeded: $45.0000 spent, $1.0000 available"


@pytest.mark.parametrize("limit", [None, 0, 0.0])
def test_no_limit_no_check(table, one, limit):
    priced = price_requests(table([("r", 1, "gpt-4", 500_000, 500_000)], USAGE))
    assert one(budget_status(priced, limit, ["seq"]))["alert"] is None


def test_negative_limit(table):
    priced = price_requests(table([("r", 1, "gpt-4", 1, 1)], USAGE))
    with pytest.raises(ValueError):
        budget_alerts(priced, -1.0, ["seq"])


@pytest.mark.parametrize("partition", [[], ["run"]])
def test_running_sum_over_a_hot_partition(spark, table, partition):
    """One run has two thirds of the rows; null is a run of its own."""
    rng = random.Random(5)
    runs = ["hot", "hot", "hot", "hot", "a", None]
    rows = [(rng.choice(runs), rng.randrange(10**6) * 5000 + i, rng.randrange(100))
            for i in range(5000)]
    df = table(rows, "run string, seq long, x long").repartition(16)
    got = running_sum(df, ["seq"], {"upto": "x"}, partition).collect()
    expected, totals = {}, {}
    for run, seq, x in sorted(rows, key=lambda r: r[1]):
        key = run if partition else 0
        totals[key] = totals.get(key, 0) + x
        expected[seq] = totals[key]
    assert {r.seq: r.upto for r in got} == expected
    assert len(got) == len(rows)


@pytest.mark.parametrize("slices", [1, 8, 40])
@pytest.mark.parametrize("partition", [[], ["run"]])
def test_running_sum_with_nulls_at_slice_starts(spark, table, partition, slices):
    """Nulls over several slices, at the start of a run, and in a whole run."""
    rows = [("a", i, None if 500 <= i < 1500 or i < 20 else i % 7) for i in range(2000)]
    rows += [("b", i, None) for i in range(2000, 2400)] + [(None, i, 1) for i in range(2400, 2500)]
    df = table(rows, "run string, seq long, x long").repartition(16)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_sum(df, ["seq"], {"upto": "x"}, partition, slices=slices).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    expected, totals = {}, {}
    for run, seq, x in rows:
        key = run if partition else 0
        if x is not None:
            totals[key] = totals.get(key, 0) + x
        expected[seq] = totals.get(key)
    assert {r.seq: r.upto for r in got} == expected
    assert len(got) == len(rows)


def test_hot_partition_is_cut_into_slices(table):
    df = table([("hot", i, 1) for i in range(20_000)], "run string, seq long, x long")
    sizes = [r["count"] for r in slice_table(df, ["run", "seq"]).groupBy(SLICE).count().collect()]
    assert len(sizes) == SLICES and max(sizes) < 2 * 20_000 / SLICES


def test_running_sum_needs_order(table):
    with pytest.raises(ValueError):
        running_sum(table([(1,)], "x long"), [], {"s": "x"})


def test_cumulative_cost_columns(table):
    priced = price_requests(table([("r", 2, "gpt-4", 1, 1), ("r", 1, "gpt-4", 2, 2)], USAGE))
    rows = {r.seq: r for r in cumulative_cost(priced, ["seq"]).collect()}
    assert rows[2].cumulative_tokens == 6
    assert rows[1].cumulative_cost == pytest.approx(rows[1].cost)


def test_exact_medians(table):
    import statistics

    rng = random.Random(2)
    columns = {
        "even": [rng.random() for _ in range(500)],
        "odd": [float(rng.randrange(5)) for _ in range(501)],
        "one": [3.0],
        "same": [2.0] * 400,
    }
    rows = [(c, v) for c, vs in columns.items() for v in [*vs, None, float("nan")]]
    got = exact_medians(table(rows, "column string, value double")).collect()
    assert {r["column"]: r["median"] for r in got} == {
        c: statistics.median(vs) for c, vs in columns.items()
    }
