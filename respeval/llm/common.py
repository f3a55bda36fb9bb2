"""What the operators share: tables, stored intermediate tables, maps over texts, key ranges."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respeval.sources.storage import write_and_read

# Texts are worked on in blocks of about this many characters, however large an Arrow batch is.
BLOCK_CHARS = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read back: cuts the lineage."""
    return write_and_read(df, name)


def id_and_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns with private names, so that a caller's other columns cannot clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def blocks(
    batches: Iterator[pa.RecordBatch], text_col: str = "text", chars: int = BLOCK_CHARS
) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into blocks of whole rows with about ``chars`` bytes of text each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text_col)).fill_null(0)
        ends = np.cumsum(np.asarray(sizes, dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(ends[at - 1]) if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + chars, side="right")))
            yield batch.slice(at, to - at)
            at = to


def map_blocks(
    df: DataFrame,
    function: Callable[[pa.RecordBatch], pa.RecordBatch],
    schema: str,
    text_col: str = "text",
) -> DataFrame:
    """Apply a function from a block of rows to a block of rows; narrow, without a shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, text_col):
            yield function(block)

    return df.mapInArrow(run, schema)


# Ranges of keys: so many at most, each from so many sampled keys.
MOST_RANGES = 100_000
SAMPLED_PER_RANGE = 20


def range_cuts(df: DataFrame, keys: Sequence[str], ranges: int) -> list[tuple]:
    """Increasing keys that cut a table, ordered by ``keys``, into ranges of near equal counts.

    At most ``ranges - 1`` and ``MOST_RANGES - 1``, from a sample of bounded size that comes to the driver. Keys may be
    of any type that Spark orders; several of them keep a frequent first one from filling a range.
    """
    ranges = min(ranges, MOST_RANGES)
    if ranges < 2:
        return []
    rows = df.select(*keys)
    share = min(1.0, SAMPLED_PER_RANGE * ranges / max(1, rows.count()))
    sample = [tuple(r) for r in rows.sample(share, seed=1).orderBy(*keys).collect()]
    picked = [sample[i * len(sample) // ranges] for i in range(1, ranges)] if sample else []
    return list(dict.fromkeys(picked))


def _ranks(values: np.ndarray, cuts: list) -> tuple[np.ndarray, np.ndarray]:
    """How many cuts are below each value, and how many at or below it."""
    if not cuts:
        nothing = np.zeros(len(values), np.int64)
        return nothing, nothing
    bounds = np.array(cuts, dtype=values.dtype if values.dtype != object else object)
    return np.searchsorted(bounds, values, "left"), np.searchsorted(bounds, values, "right")


def _numbers(columns: list[tuple[np.ndarray, np.ndarray]], cuts: list[tuple]) -> np.ndarray:
    """The number of cuts at or below each row; a column is (is null, value), and nulls come first."""
    null, values = columns[0]
    if not columns[1:]:
        known = [c[0] for c in cuts if c[0] is not None]
        nulls = len(cuts) - len(known)
        out = np.full(len(values), nulls, np.int64)
        out[~null] += _ranks(values[~null], known)[1]
        return out
    heads = list(dict.fromkeys(c[0] for c in cuts))
    first = np.cumsum([0, *(len(list(g)) for _, g in groupby(cuts, key=lambda c: c[0]))])
    known = heads[1:] if heads and heads[0] is None else heads
    skipped = len(heads) - len(known)
    low, high = np.zeros(len(values), np.int64), np.full(len(values), skipped, np.int64)
    below, upto = _ranks(values[~null], known)
    low[~null], high[~null] = below + skipped, upto + skipped
    out = first[low]
    # Rows whose first key is that of some cuts: the other keys decide among these.
    for head in np.unique(low[high > low]).tolist():
        rows = np.flatnonzero((low == head) & (high > low))
        rest = [(n[rows], v[rows]) for n, v in columns[1:]]
        out[rows] += _numbers(rest, [c[1:] for c in cuts[first[head] : first[head + 1]]])
    return out


def with_range(df: DataFrame, keys: Sequence[str], cuts: list[tuple], name: str = "part") -> DataFrame:
    """Add the number of the range that a row falls in: the number of cuts at or below it.

    A binary search per row in a vectorised function; the cuts are broadcast, not written into the plan.
    """
    if not cuts:
        return df.withColumn(name, F.lit(0))
    shared = df.sparkSession.sparkContext.broadcast(cuts)

    @F.pandas_udf("int")
    def number(columns: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in columns:
            pairs = [(parts[i].to_numpy(bool), parts[i + 1].to_numpy()) for i in range(0, len(parts), 2)]
            yield pd.Series(_numbers(pairs, shared.value).astype(np.int32))

    filled = []
    for k in keys:
        # A null's value does not matter; without nulls whole numbers stay whole.
        some = next((c[keys.index(k)] for c in cuts if c[keys.index(k)] is not None), None)
        c = F.col(f"`{k}`")
        fallback = F.lit(some).cast(df.schema[k].dataType) if some is not None else c
        filled += [c.isNull(), F.coalesce(c, fallback)]
    return df.withColumn(name, number(*filled))


def most_frequent(df: DataFrame, count: str, most: int) -> DataFrame:
    """The rows with the highest counts, at most ``most``: all from some count on, found from a count of counts.

    Counts are taken together in sixteenths of a power of two, so under a thousand rows come to the driver.
    """
    level = F.floor(F.log2(F.col(count)) * 16)
    sizes = df.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, rows = None, 0
    for r in sorted(sizes, key=lambda r: -r["level"]):
        rows += r["n"]
        if rows > most:
            break
        least = r["level"]
    return df.filter(F.lit(False) if least is None else level >= least)
