from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from respeval.llm import mixture
from tests.llm.data import SCHEMA, awkward


def by_hand(sizes: dict, weights=(5, 2, 1), most=3) -> dict:
    """Targets by resharing the excess until no source is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    capped: set = set()
    total = sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = sum(weight[s] for s in order if s not in capped)
        target = {s: most * sizes[s] if s in capped else rest * weight[s] / free for s in order}
        above = {s for s in order if s not in capped and target[s] > most * sizes[s]}
        if not above:
            return target
        capped |= above


@pytest.mark.parametrize("seed", range(6))
def test_targets(table, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}é" if i % 3 else f"S{i}": rng.choice([0, 1, 5, 1000, 10**6]) + rng.randrange(9) for i in range(12)}
    sizes[None] = rng.randrange(1, 10**4)
    got = mixture.targets(table(list(sizes.items()), "source string, source_size long")).collect()
    assert {r.source: r.target for r in got} == pytest.approx(by_hand(sizes))


def test_a_hot_source_and_repeats(table):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(1, 60), rng.choice(["hot"] * 6 + ["b", "c", "tiny", None])) for i in range(3000)]
    docs = table(rows, "doc_id long, text string, source string")
    got = mixture.mix(docs).collect()
    sizes = defaultdict(int)
    taken = defaultdict(int)
    for r in got:
        assert r["size"] == len(rows[r.doc_id][1].split()) and r.taken % r["size"] == 0
        assert r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    target = by_hand(sizes)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 30
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixture.mix(docs).collect()), key=repr)
    mixed = mixture.mixed(docs)
    assert mixed.columns == docs.columns
    copies = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert copies == {r.doc_id: r.taken // r["size"] for r in got if r.taken}


def test_selection_is_a_prefix_in_key_order(table):
    rows = [(i, f"word{i} " * (1 + i % 40), "ab"[i % 5 == 0]) for i in range(1200)]
    docs = table(rows, "doc_id long, text string, source string")
    keys = {r.doc_id: r.k for r in docs.select("doc_id", mixture.sample_key(F.col("doc_id"), F.col("text")).alias("k")).collect()}
    for source in "ab":
        got = [r for r in mixture.mix(docs).collect() if r.source == source]
        times = [r.taken // r["size"] for r in sorted(got, key=lambda r: keys[r.doc_id])]
        assert times == sorted(times, reverse=True) and max(times) - min(times) <= 1


@pytest.mark.parametrize("quality", ["word ", "0123 ", "mixed"])
def test_long_ranges_are_cut_again(table, monkeypatch, quality):
    """The same choice however short the ranges are that are sorted; keys of low quality lie close together."""
    rng = random.Random(14)
    words = {"word ": ["word "], "0123 ": ["0123 "], "mixed": ["word ", "0123 ", "a1 "]}[quality]
    rows = [(i, rng.choice(words) * rng.choice([0, 1, 3, 50]), rng.choice("aaab")) for i in range(2500)]
    rows += [(None, "copy " * 3, "a")] * 40 + [(7000, "w " * 3000, "c")]
    docs = table(rows, "doc_id long, text string, source string")
    expected = sorted(map(str, mixture.mix(docs).collect()))
    sorted_rows = []
    real = mixture._narrowed

    def narrowed(rows):
        out = real(rows)
        sorted_rows.append(max((r["count"] for r in out[0].groupBy("source", "part", "before").count().collect()), default=0))
        return out

    monkeypatch.setattr(mixture, "_narrowed", narrowed)
    monkeypatch.setattr(mixture, "SORTED", 5)
    for ranges, most in ((1024, 45), (3, 700)):
        monkeypatch.setattr(mixture, "RANGES", ranges)
        assert sorted(map(str, mixture.mix(docs).collect())) == expected
        assert sorted_rows[-1] <= most


def test_a_source_of_digits(table, monkeypatch):
    """No range of a hundredth of the source or more is sorted."""
    monkeypatch.setattr(mixture, "SORTED", 200)
    docs = table([(i, "12345 678", "low") for i in range(20_000)] + [(-1, "a " * 90_000, "z")], "doc_id long, text string, source string")
    keyed = mixture._keyed(docs, "doc_id", "text", "source", 17)
    real, seen = mixture._narrowed, []
    monkeypatch.setattr(mixture, "_narrowed", lambda rows: seen.append((rows.count(), real(rows))) or seen[-1][1])
    mixture.cuts(keyed, weights=(1, 9)).collect()
    assert seen[0][1][0].count() <= 200


def test_better_texts_come_earlier(table):
    rows = [(i, "word " * 10 if i % 2 else "#1; " * 10, "a") for i in range(2000)] + [(5000, "x " * 40_000, "b")]
    got = mixture.mix(table(rows, "doc_id long, text string, source string"), weights=(1, 39)).collect()
    kept = [r.doc_id % 2 for r in got if r.source == "a" and r.taken]
    assert 100 < len(kept) < 1900 and sum(kept) > 0.75 * len(kept)


def test_awkward_documents(table, spark):
    docs = table(awkward(), SCHEMA)
    got = mixture.mix(docs).collect()
    assert len(got) == docs.count()
    words = {r[0]: len((r[1] or "").encode().split()) for r in awkward()}
    assert all(r["size"] == words[r.doc_id] for r in got if r.doc_id is not None)
    assert mixture.mixed(docs).columns == docs.columns
    empty = spark.createDataFrame([], SCHEMA)
    assert mixture.mix(empty).count() == 0 and mixture.mixed(empty).count() == 0
    nothing = table([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    assert {(r.target, r.taken) for r in mixture.mix(nothing).collect()} == {(0.0, 0)}
