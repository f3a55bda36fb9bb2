"""The budget of every run over a stream of usage, with one total per run in Spark's state store.

Two queries work together. The first follows the usage: it adds up the running cost inside each
micro-batch, spread over all tasks even if one run makes up most of it, and stores the rows and one sum
per run. The second follows these sums: keyed state holds what each run has spent, so no row of usage is ever
sent to a run's state. What a run had spent before a batch is then added to the stored rows, and those over
the limits become alerts.

Both queries may repeat a batch. Rows and alerts are stored under the number of the usage batch, so a
repeated one replaces them. The state remembers the last batch that it counted, and what stood before it: a
sum that comes again replaces itself.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from respeval.operators.running import alert_columns, check_limit, cumulative_cost, plus
from respeval.sources.storage import BROADCAST_ROWS, remove

# The state function ships with its task, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Tasks that hold the state: a row per run and batch passes through them.
STATE_TASKS = 8

_STATE = "last long, before double, total double"


def _plus(a: float | None, b: float | None) -> float | None:
    if a is None or b is None:
        return b if a is None else a
    return a + b


def _carry(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """What the run had spent before each batch whose sum comes in."""
    last, before, total = state.get if state.exists else (-1, None, None)
    rows = pd.concat(frames).sort_values("batch_id")
    out = []
    for batch, spent in zip(rows["batch_id"].tolist(), rows["spent"].tolist(), strict=True):
        if batch < last:
            continue  # replaced long ago
        if batch > last:
            last, before = batch, total
        total = _plus(before, None if pd.isna(spent) else spent)
        out.append((key[0], batch, before))
    state.update((last, before, total))
    yield pd.DataFrame(out, columns=["run", "batch_id", "before"])


def usage_sink(path: str, order_by: Sequence[str], run: str = "run") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function of the first query.

    Stores the rows of a batch with their running cost under ``path/running/batch_id=<id>``, and the sum of each
    run in ``path/sums``. The batch is read once and kept for that time.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            running = cumulative_cost(batch, order_by, [run])
            running.write.mode("overwrite").parquet(f"{path}/running/batch_id={batch_id}")
            sums = batch.groupBy(F.col(run).alias("run")).agg(F.sum("cost").alias("spent"))
            sums = sums.select("run", F.lit(batch_id).cast("long").alias("batch_id"), "spent")
            sums.write.mode("append").parquet(f"{path}/sums")
        finally:
            batch.unpersist()

    return on_batch


def _alerts_of(spark: SparkSession, path: str, limit: float, run: str, batch_id: int, carried: DataFrame) -> DataFrame:
    rows = spark.read.parquet(f"{path}/running/batch_id={batch_id}")
    own = carried.filter(F.col("batch_id") == batch_id)
    own = own.select(F.col("run").alias("__run"), F.col("before").alias("__before"))
    joined = rows.join(own, F.col(run).eqNullSafe(F.col("__run")), "left")
    total = plus(F.col("cumulative_cost"), F.col("__before"))
    kind, message = alert_columns(F.col("cumulative_cost"), limit)
    columns = [c for c in rows.columns if c not in ("cumulative_cost", "cumulative_tokens")]
    return (
        joined.withColumn("cumulative_cost", total)
        .select(*columns, "cumulative_cost")
        .withColumn("alert", kind)
        .withColumn("message", message)
        .filter(F.col("alert").isNotNull())
    )


def alert_sink(spark: SparkSession, path: str, limit: float, run: str = "run") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function of the second query: writes ``path/alerts/batch_id=<usage batch>``.

    Stored rows are dropped once their alerts, and those of a later batch, have been written.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.dropDuplicates(["run", "batch_id"]).write.mode("overwrite").parquet(f"{path}/carried/{batch_id}")
        carried = spark.read.schema(batch.schema).parquet(f"{path}/carried/{batch_id}")
        counts = carried.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n")).orderBy("batch_id").collect()
        for r in counts:  # usually one
            own = F.broadcast(carried) if r["n"] <= BROADCAST_ROWS else carried
            alerts = _alerts_of(spark, path, limit, run, r["batch_id"], own)
            alerts.write.mode("overwrite").parquet(f"{path}/alerts/batch_id={r['batch_id']}")
        if batch_id and counts:
            done = spark.read.schema(batch.schema).parquet(f"{path}/carried/{batch_id - 1}")
            for r in done.select("batch_id").distinct().collect():
                if r["batch_id"] < counts[0]["batch_id"]:
                    remove(spark, f"{path}/running/batch_id={r['batch_id']}")
            remove(spark, f"{path}/carried/{batch_id - 2}")

    return on_batch


def spent_before(sums: DataFrame) -> DataFrame:
    """A stream of (run, batch_id, spent) to (run, batch_id, before); keeps one total per run as state."""
    kind = T.StructType([sums.schema["run"], *T.StructType.fromDDL("batch_id long, before double")])
    return sums.groupBy("run").applyInPandasWithState(_carry, kind, _STATE, "update", GroupStateTimeout.NoTimeout)


def raise_alerts(
    spark: SparkSession, path: str, limit: float, run_type: T.DataType, run: str = "run"
) -> StreamingQuery:
    """Bring state and alerts up to date with all sums that the first query has stored."""
    check_limit(limit)
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", STATE_TASKS)
    schema = T.StructType([T.StructField("run", run_type), *T.StructType.fromDDL("batch_id long, spent double")])
    before = spent_before(own.readStream.schema(schema).parquet(f"{path}/sums"))
    query = (
        before.writeStream.outputMode("update")
        .foreachBatch(alert_sink(own, path, limit, run))
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def budget_sink(path: str, limit: float, order_by: Sequence[str], run: str = "run") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that does both steps for every batch of usage.

    Rows are ordered inside a micro-batch; a row that arrives in a later batch counts as later spending.
    Alerts are under ``path/alerts`` when the batch is over.
    """
    check_limit(limit)
    store = usage_sink(path, order_by, run)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        store(batch, batch_id)
        raise_alerts(batch.sparkSession, path, limit, batch.schema[run].dataType, run)

    return on_batch


def follow_budget(
    usage: DataFrame, path: str, limit: float, order_by: Sequence[str], checkpoint: str, run: str = "run"
) -> DataFrame:
    """Run both queries over all usage there is; returns all alerts so far."""
    check_limit(limit)
    query = (
        usage.writeStream.foreachBatch(usage_sink(path, order_by, run))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    raise_alerts(usage.sparkSession, path, limit, usage.schema[run].dataType, run)
    return read_alerts(usage, path)


def read_alerts(usage: DataFrame, path: str) -> DataFrame:
    """All alerts stored so far, for usage with the columns of ``usage``."""
    extra = T.StructType.fromDDL("cumulative_cost double, alert string, message string, batch_id long")
    names = [*usage.columns, *(f.name for f in extra[:3])]
    schema = T.StructType([*usage.schema.fields, *extra])
    return usage.sparkSession.read.schema(schema).parquet(f"{path}/alerts").select(*names)
