"""Whole-table operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame


def ragged_union(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; a column a table lacks is null in its rows. Columns in name order."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    return union.select(*sorted(union.columns))
