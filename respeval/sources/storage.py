"""The shared folder for tables that a job writes and reads again."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A join side within both bounds is broadcast.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64 * 1024 * 1024


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, or the program by setCheckpointDir.

    A local session without either, where all tasks run on this machine, gets one temporary folder,
    set as its checkpoint folder.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="respeval-"))
        return context.getCheckpointDir().rstrip("/")
    raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder, if it is there, through Spark's own file systems."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def release(spark: SparkSession) -> None:
    """Delete all that this application stored; lazy results over it can no longer be read."""
    remove(spark, f"{shared_folder(spark)}/respeval/{spark.sparkContext.applicationId}")


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, below a folder of this application.

    Lazy tables read these files later, so they stay until ``release``.
    """
    run = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/respeval/{run}/{name}-{uuid.uuid4().hex}"


def write_and_read(df: DataFrame, name: str) -> DataFrame:
    """Store a table in the shared folder and read it back.

    Cuts the lineage, so values that depend on how a shuffle fell out (such as the partition
    number) stay the same in every later use, also when executors are lost.
    """
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(
    side: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """A join side, marked for broadcast if it proves small; else left to a shuffle join.

    The side is stored first and measured, which runs when this is called, so it is computed once
    and keeps that state. With a broadcast the other, long side is not shuffled at all. Beyond the
    bounds both are shuffled, where adaptive execution splits the partitions of frequent keys.
    Measuring stops at the bound on rows.
    """
    stored = write_and_read(side, "side")
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in stored.columns]))
    rows, size = (
        stored.limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(text)), F.lit(0)))
        .first()
    )
    return F.broadcast(stored) if rows <= max_rows and size <= max_bytes else stored
