from __future__ import annotations

import pytest
from pyspark.sql import SparkSession

from respeval.session import local_session


@pytest.fixture(scope="session")
def spark() -> SparkSession:
    return local_session("tests", "8")


@pytest.fixture
def table(spark):
    """Rows and a schema string to a DataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


@pytest.fixture
def one(spark):
    """The only row of a DataFrame as a dict."""

    def get(df) -> dict:
        (row,) = df.collect()
        return row.asDict(recursive=True)

    return get
