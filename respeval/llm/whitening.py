"""Whitening of embeddings by their weighted covariance, one distinct vector at a time.

Entries become whole numbers, x = floor(64 * c) + 1000000. Equal x vectors are grouped; a distinct
vector enters the fit with the number of its rows as its weight (``weights="count"``), or with one
(``weights="one"``). Sums are exact integers. The covariance is a weighted product of the centred
vectors, summed per task and then over the tasks in two rounds. Its eigenvectors are found on the
driver, as the matrix is as large as the dimensions make it, whatever the number of rows. Every
distinct vector is whitened once and joined back to its rows.

No more than ``HOT`` vectors can each make up a share of 1 / ``HOT`` of the rows, so those are broadcast with
their results; the rows of all others meet theirs in a join on the vector's SHA-256 digest, in which no
key is frequent.

Defined cases: rows whose vector is null, empty, or holds null or non-finite entries are dropped; the
dimension is the length that most rows have (the longer one in a tie), and rows of any other length
are dropped as well; 64 * c is held within +-2^40. Null and repeated ids stay, each row for itself. A
component without variance (up to rounding) has a null ``whitened`` and is left out of the identity
check, which is null if no component has any. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from respeval.llm.common import stored

SCALE = 64
OFFSET = 1_000_000
# Scaled entries are held within this, so that they are exact in every step.
LARGEST = float(1 << 40)
COMPONENTS = 32
# The covariance, a square of this many numbers at most, is kept by a task and the driver.
MOST_DIMENSIONS = 4096
# So many vectors at most are broadcast: those with a share of the rows of 1 / HOT or more.
HOT = 1000
# Groups in the first round of sums over tasks.
ROUNDS = 32

_RESULT = (
    "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
)


def quantized(vector: Column) -> Column:
    """x of a vector."""
    scaled = F.transform(vector, lambda c: F.least(F.greatest(c.cast("double") * SCALE, F.lit(-LARGEST)), F.lit(LARGEST)))
    return F.transform(scaled, lambda c: F.floor(c).cast("long") + F.lit(OFFSET).cast("long"))


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite numbers."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite, F.lit(False))


def _matrix(column: pa.Array, dtype: type) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1)


def _exact(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """values * weights summed by column as Python integers, without overflow."""
    high, low = values >> 20, values & ((1 << 20) - 1)
    # Both halves stay below 2^22 and 2^20, a batch below 2^40 rows' weight.
    parts = (high.T @ weights, low.T @ weights)
    return (parts[0].astype(object) << 20) + parts[1].astype(object)


def _count_and_sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """The weight of all vectors, and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                w = batch.column("weight").to_numpy()
                here = np.concatenate([[int(w.sum())], _exact(_matrix(batch.column("x"), np.int64), w)])
                total = here if total is None else total + here
        if total is not None:
            sums = pa.array([Decimal(int(v)) for v in total], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), sums], names=["i", "sum"])

    parts = distinct.select("weight", "x").mapInArrow(run, "i int, sum decimal(38,0)")
    rows = parts.groupBy("i").agg(F.sum("sum").alias("sum")).collect()
    sums = [int(r["sum"]) for r in sorted(rows, key=lambda r: r.i)]
    return sums[0], sums[1:]


def _sum_rows(batches: pa.Table) -> np.ndarray:
    return _matrix(batches.column("row").combine_chunks(), np.float64).sum(axis=0)


def _covariance(vectors: DataFrame, column: str, centre: np.ndarray, rest: np.ndarray, n: int) -> np.ndarray:
    """Weighted covariance of a column of vectors about ``centre + rest``, divided by n.

    Every task sends one square; rows of it are added in two rounds, each row by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(centre), len(centre)))
        seen = False
        for batch in batches:
            if batch.num_rows:
                seen = True
                x = (_matrix(batch.column(column), centre.dtype) - centre).astype(np.float64) - rest
                total += (x * batch.column("weight").to_numpy()[:, None]).T @ x
        if seen:
            ends = pa.array(np.arange(len(total) + 1, dtype=np.int32) * len(total))
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(total)), pa.int32()),
                    pa.array(np.full(len(total), part % ROUNDS, np.int32)),
                    pa.ListArray.from_arrays(ends, pa.array(total.ravel())),
                ],
                names=["i", "part", "row"],
            )

    def add(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1).drop_columns("row")
        return first.append_column("row", pa.array([_sum_rows(table)], pa.list_(pa.float64())))

    kind = "i int, part int, row array<double>"
    parts = vectors.select("weight", column).mapInArrow(run, kind)
    some = parts.groupBy("i", "part").applyInArrow(add, kind)
    rows = some.groupBy("i").applyInArrow(add, kind).collect()
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r.i)]) / n


def components(covariance: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors as columns; largest entries positive."""
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values, kind="stable")[::-1][:most]
    values, vectors = values[order], vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))])
    return values, vectors * np.where(signs == 0, 1, signs)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> list[Decimal]:
    """Exact sums of (n * x - S)^2."""
    means = np.array([s // n for s in sums], np.int64)
    near = x - means  # n * x - S = n * near - (S - n * mean)
    left = [s - n * int(m) for s, m in zip(sums, means, strict=True)]
    most = int(np.abs(near).max(initial=0)) * n + n
    if most**2 * max(len(sums), 1) < 1 << 62:
        d = near * n - np.array(left, np.int64)
        return [Decimal(int(v)) for v in (d * d).sum(axis=1)]
    wide = near.astype(object) * n - np.array(left, object)
    return [Decimal(int(v)) for v in (wide * wide).sum(axis=1)]


def _whiten(distinct: DataFrame, n: int, sums: list[int], axes: np.ndarray) -> DataFrame:
    """key, rows, weight, deviation and whitened of each distinct vector."""
    centre = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - n * int(c)) / n for s, c in zip(sums, centre, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("x"), np.int64) if batch.num_rows else np.zeros((0, len(centre)), np.int64)
            white = ((x - centre) - rest) @ axes
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * axes.shape[1])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("key"),
                    batch.column("rows"),
                    batch.column("weight"),
                    pa.array(_deviations(x, n, sums), pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(ends, pa.array(white.ravel())),
                ],
                names=["key", "rows", "weight", "deviation", "whitened"],
            )

    kind = "key binary, rows long, weight long, deviation decimal(38,0), whitened array<double>"
    return distinct.mapInArrow(run, kind)


def _identity_error(white: DataFrame, n: int, k: int) -> float | None:
    """The largest entry of the covariance of whitened vectors minus the identity."""
    if not k:
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                total += batch.column("weight").to_numpy() @ _matrix(batch.column("whitened"), np.float64)
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(total)], names=["i", "sum"])

    parts = white.select("weight", "whitened").mapInArrow(run, "i int, sum double")
    rows = parts.groupBy("i").agg(F.sum("sum").alias("sum")).collect()
    mean = np.array([r["sum"] for r in sorted(rows, key=lambda r: r.i)]) / n
    return float(np.abs(_covariance(white, "whitened", mean, np.zeros(k), n) - np.eye(k)).max())


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", weights: str = "count",
    most: int = COMPONENTS,
) -> DataFrame:
    """vec_id and, for each row and component, n, deviation, whitened, explained and identity_error.

    ``weights`` is "count" or "one". ``n`` is the weight of all distinct vectors. The fit runs when this is called.
    """
    if weights not in ("count", "one"):
        raise ValueError(f"weights must be count or one, got {weights}")
    vector = F.col(f"`{vector_col}`")
    rows = vectors.filter(usable(vector)).select(F.col(f"`{id_col}`").alias("vec_id"), quantized(vector).alias("x"))
    kind = rows.schema["vec_id"].dataType.simpleString()
    sizes = rows.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    size = sizes.orderBy(F.desc("n"), F.desc("size")).first()
    if size is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, {_RESULT}")
    if size["size"] > MOST_DIMENSIONS:
        raise ValueError(f"more than {MOST_DIMENSIONS} dimensions")
    key = F.unhex(F.sha2(F.concat_ws(",", F.col("x").cast("array<string>")), 256))
    rows = stored(rows.filter(F.size("x") == size["size"]).withColumn("key", key), "vectors")
    distinct = rows.groupBy("key", "x").agg(F.count(F.lit(1)).alias("rows"))
    weight = F.col("rows") if weights == "count" else F.lit(1).cast("long")
    distinct = stored(distinct.withColumn("weight", weight), "distinct")

    n, sums = _count_and_sums(distinct)
    centre = np.array([s // n for s in sums], np.int64)
    rest = np.array([(s - n * int(c)) / n for s, c in zip(sums, centre, strict=True)])
    covariance = _covariance(distinct, "x", centre, rest, n)
    values, axes = components(covariance, most)
    trace = float(np.trace(covariance))
    there = values > max(values[0], 0.0) * len(sums) * np.finfo(float).eps
    axes = axes[:, there] / np.sqrt(values[there])
    white = stored(_whiten(distinct, n, sums, axes), "whitened")
    error = _identity_error(white, n, axes.shape[1])

    hot = white.filter(F.col("rows") >= F.lit(-(-size["n"] // HOT))).select("key", "deviation", "whitened")
    names = F.broadcast(hot.select("key"))
    some = rows.select("vec_id", "key")
    joined = some.join(F.broadcast(hot), "key").unionByName(
        some.join(names, "key", "left_anti").join(white.join(names, "key", "left_anti").select(*hot.columns), "key")
    )
    # Components without variance are the last ones.
    whole = F.concat("whitened", F.array_repeat(F.lit(None).cast("double"), int((~there).sum())))
    shares = F.array(*[F.lit(float(v) / trace if trace > 0 else 0.0) for v in values])
    each = joined.select("vec_id", "deviation", F.posexplode(F.arrays_zip(whole.alias("w"), shares.alias("e"))).alias("place", "c"))
    return each.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        F.col("c.w").alias("whitened"),
        F.col("c.e").alias("explained"),
        F.lit(error).cast("double").alias("identity_error"),
    )
