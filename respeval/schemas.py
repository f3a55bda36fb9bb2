"""Schemas of the stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

_string, _long, _double = T.StringType(), T.LongType(), T.DoubleType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


CRITERIA = _table(
    min_tokens=T.IntegerType(),
    max_tokens=T.IntegerType(),
    must_include=T.ArrayType(_string),
    format=_string,
)
PROMPT = _table(
    id=_string,
    version=_string,
    category=_string,
    difficulty=_string,
    tags=T.ArrayType(_string),
    text=_string,
    prompt=_string,
    expected_criteria=CRITERIA,
)
PROMPT_FILE = _table(
    metadata=_table(version=_string, description=_string, created=_string),
    prompts=T.ArrayType(PROMPT),
)
RAW_RESULTS = _table(
    prompt_id=_string,
    prompt=_string,
    response=_string,
    model=_string,
    timestamp=T.TimestampType(),
    status=_string,
    error=_string,
    prompt_tokens=_long,
    response_tokens=_long,
)
USAGE = _table(
    run=_string,
    timestamp=T.TimestampType(),
    model=_string,
    prompt_id=_string,
    input_tokens=_long,
    output_tokens=_long,
    cost=_double,
)
