from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from respeval.llm import sharding
from tests.llm.data import SCHEMA, awkward


def one_by_one(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing by its definition."""
    shards: list[list] = []
    room: list[int] = []
    for size in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(room) if r >= size]
        if fits:
            _, i = min(fits)
        else:
            i = len(room)
            room.append(max(capacity, size))
            shards.append([])
        room[i] -= size
        shards[i].append(size)
    return shards


@pytest.mark.parametrize("seed", range(20))
def test_runs_equal_one_by_one(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 5, 7, 7, 7, 20, 40, 65]) * rng.choice([1, 1, 3]) for _ in range(300)]
    capacity = rng.choice([30, 64, 100, 1000])
    counts = sorted(Counter(sizes).items(), reverse=True)
    got = defaultdict(list)
    for size, first, last, shard in sharding.best_fit_decreasing(counts, capacity):
        got[shard] += [size] * (last - first + 1)
    assert [got[i] for i in range(len(got))] == one_by_one(sizes, capacity)


def test_tree_equals_a_sorted_list():
    rng = random.Random(2)
    tree, plain = sharding.CapacityTree(), []
    for i in range(5000):
        if rng.random() < 0.6 or not plain:
            entry = (rng.randrange(3000), i)
            tree.add(*entry)
            plain.append(entry)
        else:
            size = rng.randrange(3200)
            fits = [e for e in plain if e[0] >= size]
            expected = min(fits, default=None)
            if expected:
                plain.remove(expected)
            assert tree.take(size) == expected
    assert all(len(b) <= tree.BLOCK for b in tree.blocks)


def check(rows, got, shards=None):
    sizes = sorted((i if i is not None else -1, len((t or "").encode()) + 16) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["size"]) for r in got) == sizes
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert shards is None or 0 <= r.shard < shards
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    for r in got:
        text = dict(rows).get(r.doc_id)
        if r.doc_id is not None:
            assert r.text_crc32 == (None if text is None else zlib.crc32(text.encode()))


def test_awkward_documents(table):
    rows = awkward()
    got = sharding.balance(table(rows, SCHEMA), 4).collect()
    check([r[:2] for r in rows], got, 4)


def test_hot_group_is_cut_and_others_stay_whole(table):
    rng = random.Random(1)
    texts = ["hot text of the group"] * 700 + [f"text {rng.randrange(400)} " * rng.randrange(1, 9) for _ in range(1300)]
    rows = list(enumerate(texts))
    got = sharding.balance(table(rows, "doc_id long, text string"), 10).collect()
    check(rows, got, 10)
    loads = Counter()
    where = defaultdict(set)
    for r in got:
        loads[r.shard] += r["size"]
        where[texts[r.doc_id]].add(r.shard)
    assert len(loads) == 10 and max(loads.values()) - min(loads.values()) < 0.02 * sum(loads.values()) / 10
    assert all(len(s) == 1 for t, s in where.items() if t != texts[0])


def test_fixed_capacity(table):
    rng = random.Random(4)
    rows = [(i, "y" * rng.randrange(500)) for i in range(300)] + [(300, "z" * 9000)]
    got = sharding.pack(table(rows, "doc_id long, text string"), 2000).collect()
    check(rows, got)
    loads = Counter()
    for r in got:
        loads[r.shard] += r["size"]
    assert sorted(loads.values())[-1] == 9016 and all(v <= 2000 for v in loads.values() if v != 9016)
    groups = Counter(t for _, t in rows)
    pieces = []
    for t, n in groups.items():
        size = len(t) + 16
        fit = max(1, 2000 // size)
        pieces += [min(fit, n - k) * size for k in range(0, n, fit)]
    assert len(loads) == len(one_by_one(pieces, 2000))


def test_empty_table(spark):
    got = sharding.balance(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "size", "text_crc32", "shard", "slot"] and got.count() == 0


def test_even_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    loads = [r["b"] for r in sharding.balance(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()]
    assert len(loads) == 40 and max(loads) < 1.01 * min(loads)
