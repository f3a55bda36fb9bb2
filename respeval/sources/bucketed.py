"""Results kept in buckets by id, so that joins and checks on the id move no rows.

A table in buckets is dealt out and sorted by the hash of its id once, when it is written. Two tables with as many buckets meet
bucket by bucket: which prompts have no result yet, and which ids occur twice, is then found without a
shuffle of either side, however many ids there are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from respeval.operators.quality import duplicated_keys

BUCKETS = 64


def save_bucketed(
    df: DataFrame, name: str, path: str, key: str = "prompt_id", buckets: int = BUCKETS, mode: str = "overwrite"
) -> None:
    """Write a table in buckets by ``key``, sorted, under ``path``, and register it as ``name``.

    Rows are dealt out by the buckets first, so each has one file. With ``mode="append"`` results of a later run are added; a
    bucket then has one more file, and is sorted when it is read.
    """
    dealt = df.repartition(buckets, key)
    dealt.write.mode(mode).bucketBy(buckets, key).sortBy(key).option("path", path).saveAsTable(name)


def load_bucketed(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def pending_in_buckets(prompts: DataFrame, done: DataFrame, key: str = "prompt_id") -> DataFrame:
    """``pending_prompts`` of two tables in as many buckets by ``key``: no side is moved, stored or broadcast."""
    return prompts.join(done.select(key).hint("merge"), key, "left_anti")


def repeated_in_buckets(df: DataFrame, key: str = "prompt_id") -> DataFrame:
    """All rows whose ``key`` occurs more than once, of a table in buckets; nulls equal each other."""
    repeated = duplicated_keys(df, key).select(F.col(key).alias("__key"))
    same = df.join(repeated.hint("merge"), df[key] == F.col("__key"), "left_semi")
    # Nulls are in one bucket and meet no join.
    nulls = df.filter(df[key].isNull())
    several = df.filter(df[key].isNull()).agg((F.count(F.lit(1)) > 1).alias("__several"))
    return same.unionByName(nulls.join(F.broadcast(several.filter("__several")), how="left_semi"))
