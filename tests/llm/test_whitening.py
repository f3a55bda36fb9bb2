from __future__ import annotations

import math
import random

import numpy as np
import pytest

from respeval.llm import whitening
from respeval.llm.catalog import op12_whitening

SCHEMA = "vec_id long, embedding array<float>, x string, key int, n string"


def brute_force(rows, weights="count", most=32):
    """(id, x) of the rows that stay, n, deviations, whitened columns, shares; of plain numpy."""
    fine = [(i, [float(c) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    sizes = [len(v) for _, v in fine]
    size = max(set(sizes), key=lambda s: (sizes.count(s), s))
    kept = [(i, [math.floor(64 * c) + 1000000 for c in v]) for i, v in fine if len(v) == size]
    fit = [x for _, x in kept] if weights == "count" else [list(x) for x in {tuple(x) for _, x in kept}]
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) for _, x in kept]
    mean = np.array([s / n for s in sums])
    centred = np.array(fit) - mean
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    with np.errstate(divide="ignore", invalid="ignore"):
        white = (np.array([x for _, x in kept]) - mean) @ vectors / np.sqrt(values)
    return kept, n, deviations, white, values / np.trace(covariance)


def check(df, rows, weights="count", most=32, rank=99):
    kept, n, deviations, white, shares = brute_force(rows, weights, most)
    got = [r.asDict() for r in df.collect()]
    k = min(most, len(shares))
    assert len(got) == len(kept) * k
    assert {r["n"] for r in got} == {n}
    assert sorted((str(r["vec_id"]), int(r["deviation"])) for r in got if r["component"] == 1) == sorted(
        (str(i), d) for (i, _), d in zip(kept, deviations, strict=True)
    )
    for c in range(1, k + 1):
        mine = [r for r in got if r["component"] == c]
        assert all(r["explained"] == pytest.approx(max(shares[c - 1], 0), rel=1e-6, abs=1e-12) for r in mine)
        if c > rank:
            assert all(r["whitened"] is None for r in mine)
            continue
        a = sorted((str(r["vec_id"]), r["whitened"]) for r in mine)
        for sign in (1, -1):
            b = sorted((str(i), float(sign * w)) for (i, _), w in zip(kept, white[:, c - 1], strict=True))
            if [x[1] for x in a] == pytest.approx([x[1] for x in b], abs=1e-7):
                break
        else:
            raise AssertionError(f"component {c}")
    assert all(r["identity_error"] < 1e-9 for r in got)


def vectors(rng, n, size=6):
    base = [[rng.gauss(0, 1 + j) for j in range(size)] for _ in range(n)]
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(1000 + i, base[0]) for i in range(n)]  # half of all rows are one vector
    rows += [(2000 + i, list(np.array(base[1]) + 1e-9)) for i in range(5)]
    return [(i, [float(np.float32(c)) for c in v]) for i, v in rows]


@pytest.mark.parametrize("weights", ["count", "one"])
@pytest.mark.parametrize("hot", [1, 3, 1000])
def test_brute_force(table, monkeypatch, weights, hot):
    monkeypatch.setattr(whitening, "HOT", hot)
    rows = vectors(random.Random(2), 40)
    df = whitening.whiten(table(rows, "vec_id long, embedding array<float>"), weights=weights, most=4)
    check(df, rows, weights, most=4)


def test_given_vectors(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding").collect()
    check(op12_whitening(spark, "/root/testdata/sf0.01"), [tuple(r) for r in rows])


def test_awkward_vectors(table, spark):
    rng = random.Random(5)
    rows = vectors(rng, 12, 3)
    odd = [
        (None, rows[0][1]), (7, rows[7][1]), (7, rows[7][1]), (8, None), (9, []), (10, [1.0, None, 2.0]), (11, [1.0, math.nan, 2.0]),
        (12, [1.0, math.inf, 2.0]), (13, [1.0, 2.0]), (14, [1.0, 2.0, 3.0, 4.0]), (15, [0.0, -0.0, 0.0]), (None, None),
    ]
    rows += [(i, v and [None if c is None else float(np.float32(c)) for c in v]) for i, v in odd]
    df = whitening.whiten(table([(*r, "a", 1, None) for r in rows], SCHEMA))
    check(df, rows)
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(table([(1, None), (2, [])], "vec_id long, embedding array<double>")).count() == 0


def test_vectors_without_variance(table):
    """What does not vary has no whitened value."""
    same = table([("a", [1.0, 2.0]), ("b", [1.0, 2.0])], "vec_id string, embedding array<double>")
    got = whitening.whiten(same).collect()
    assert len(got) == 4 and {(int(r.deviation), r.whitened, r.explained, r.identity_error) for r in got} == {(0, None, 0.0, None)}
    rng = random.Random(1)
    line = [(i, [float(c := rng.randrange(100)), 2.0 * c, 5.0]) for i in range(30)]
    check(whitening.whiten(table(line, "vec_id long, embedding array<double>")), line, rank=1)


def test_sums_stay_exact(table):
    """Large entries go beyond 64 bits when squared."""
    rows = [(i, [float(c), -1e9 * i, 1e300 * (i - 3)]) for i, c in enumerate([1e9, -1e9, 3e9, 5.5, 7.25, 1e8, 2.0])]
    got = whitening.whiten(table(rows, "vec_id long, embedding array<double>")).collect()
    x = [[math.floor(max(-(2.0**40), min(2.0**40, 64 * c))) + 1000000 for c in v] for _, v in rows]
    sums = [sum(c) for c in zip(*x, strict=True)]
    expected = [sum((7 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    assert {r.vec_id: int(r.deviation) for r in got} == dict(enumerate(expected))
    assert max(expected) > 1 << 64
