"""Requests of the trailing minute, for every instant of a stream.

State is kept per key and span of time: the instants that are not known for good, those of the minute before
them, and their numbers. When the watermark passes the end of a minute, the calls of the last 60 seconds are
known for every instant of it. So a key's requests are dealt over the spans, equal instants of a task travel as
one, and state covers a minute and how late a request may be.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The state function ships with its task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

MINUTE = 60_000_000  # microseconds
# Minutes of a span: a state, and a call for each batch that reaches it.
SPAN = 60
_STATE = "at array<bigint>, n array<bigint>, done bigint"


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal keys and instants of a batch as one row."""
    for batch in batches:
        names = batch.schema.names
        counted = pa.Table.from_batches([batch]).group_by(names).aggregate([([], "count_all")])
        yield from counted.select([*names, "count_all"]).rename_columns([*names, "requests"]).to_batches()


def _merged(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    instants, which = np.unique(at, return_inverse=True)
    return instants, np.bincount(which, n, len(instants)).astype(np.int64)


def calls_between(
    at: np.ndarray, n: np.ndarray, start: int, end: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Instants from ``start`` to before ``end``, their requests, and the calls of their last 60 seconds."""
    upto = np.concatenate([[0], np.cumsum(n)])
    own = np.arange(*np.searchsorted(at, [start, end]))
    before = np.searchsorted(at, at[own] - MINUTE, side="right")
    return at[own], n[own], upto[own + 1] - upto[before]


def _follow(names: list[str]) -> Callable:
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *keys, span = key
        start, end = int(span) * SPAN * MINUTE, (int(span) + 1) * SPAN * MINUTE
        at, n, done = state.get if state.exists else ((), (), start)
        at, n = np.array(at, np.int64), np.array(n, np.int64)
        if not state.hasTimedOut:
            rows = pd.concat(frames)
            at, n = _merged(np.concatenate([at, rows["at"]]), np.concatenate([n, rows["requests"]]))
        mark = int(state.getCurrentWatermarkMs())
        closed = min(max(done, mark * 1000 // MINUTE * MINUTE), end)
        instants, requests, calls = calls_between(at, n, done, closed)
        # Up to the end of the next minute that has an instant, or of the span.
        ahead = at[np.searchsorted(at, closed) :]
        following = min((int(ahead[0]) // MINUTE + 1) * MINUTE if len(ahead) else end, end)
        if closed < end:
            held = at >= closed - MINUTE
            state.update((at[held].tolist(), n[held].tolist(), closed))
            state.setTimeoutTimestamp(max(following // 1000 - 1, mark))
        elif state.exists:
            state.remove()
        if len(instants):
            known = {name: [k] * len(instants) for name, k in zip(names, keys, strict=True)}
            yield pd.DataFrame(known | {"at": instants, "requests": requests, "calls_last_minute": calls})

    return step


def trailing_minute_stream(
    requests: DataFrame, time: str, keys: Sequence[str] = (), calls_per_minute: int = 60, late: str = "2 minutes"
) -> DataFrame:
    """``request_rate`` of a stream: a row per key and instant, once its minute can get no more requests.

    Requests without a time are left out, and those that come later than ``late``.
    """
    if calls_per_minute <= 0:
        raise ValueError("calls_per_minute must be positive")
    names = [f"key_{i}" for i in range(len(keys))]
    at = F.unix_micros(F.col(time).cast("timestamp"))
    rows = requests.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], at.alias("at"))
    rows = rows.filter("at is not null")
    kinds = T.StructType([*rows.schema.fields, T.StructField("requests", T.LongType())])
    rows = rows.mapInArrow(_counted, kinds).withColumn("ts", F.timestamp_micros("at")).withWatermark("ts", late)
    # The last minute of a span counts in the next one as well.
    own, after = (F.floor((F.col("at") + F.lit(m * MINUTE)) / F.lit(SPAN * MINUTE)) for m in (0, 1))
    rows = rows.withColumn("span", F.explode(F.array_distinct(F.array(own, after))))
    out = T.StructType([*kinds.fields, T.StructField("calls_last_minute", T.LongType())])
    calls = rows.groupBy(*names, "span").applyInPandasWithState(
        _follow(names), out, _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return calls.select(
        *[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)],
        F.timestamp_micros("at").alias(time),
        "requests",
        "calls_last_minute",
        F.lit(calls_per_minute).alias("calls_per_minute_limit"),
        (F.col("calls_last_minute") / F.lit(float(calls_per_minute)) * 100).alias("utilization_percent"),
    )
