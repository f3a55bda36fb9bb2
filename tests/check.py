"""Runs registered queries on Spark and DuckDB and compares schemas, counts and values.

``python -m tests.check [scale folder] [query ...]``
"""

from __future__ import annotations

import datetime
import math
import sys
import time

import duckdb

import __spark_entry__ as entry

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
# DuckDB type -> Spark types that stand for the same values.
TYPES = {
    "BIGINT": {"bigint"},
    "INTEGER": {"int"},
    "DOUBLE": {"double"},
    "VARCHAR": {"string"},
    "BOOLEAN": {"boolean"},
    "TIMESTAMP": {"timestamp_ntz"},
}


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _comparable(value: object) -> str:
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return repr(value)


def _rows(names: list[str], rows: list[tuple]) -> list[tuple[str, ...]]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_comparable(r[i]) for i in order) for r in rows)


def differences(spark, con, name: str, sf_dir: str) -> tuple[list[str], int]:
    """What differs between both engines, and the number of rows."""
    df = entry.queries()[name](spark, sf_dir)
    mine = [tuple(r) for r in df.collect()]
    result = con.execute(entry.oracle_sql()[name])
    theirs = result.fetchall()
    kinds = {d[0]: str(d[1]) for d in result.description}
    found = []
    if sorted(df.columns) != sorted(kinds):
        return [f"columns {sorted(df.columns)} != {sorted(kinds)}"], len(mine)
    for f in df.schema.fields:
        if f.dataType.simpleString() not in TYPES.get(kinds[f.name], set()):
            found.append(f"type of {f.name}: {f.dataType.simpleString()} != {kinds[f.name]}")
    if len(mine) != len(theirs):
        found.append(f"rows {len(mine)} != {len(theirs)}")
    a, b = _rows(df.columns, mine), _rows(list(kinds), theirs)
    if a != b:
        only_mine, only_theirs = set(a) - set(b), set(b) - set(a)
        found.append(f"values differ in {len(only_mine)} / {len(only_theirs)} rows")
        found += [f"  spark  {str(r)[:500]}" for r in sorted(only_mine)[:3]]
        found += [f"  duckdb {str(r)[:500]}" for r in sorted(only_theirs)[:3]]
    return found, len(mine)


def main() -> int:
    from respeval.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(entry.queries())
    spark, con = local_session(cores="8"), connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            found, rows = differences(spark, con, name, sf_dir)
        except Exception as e:  # report and go on with the next query
            found, rows = [f"{type(e).__name__}: {str(e)[:600]}"], 0
        bad += bool(found)
        print(f"{'BAD' if found else 'ok ':4}{name:28}{rows:8} rows {time.time() - start:6.2f}s")
        for line in found:
            print("     ", line, flush=True)
    print(f"{len(names) - bad} of {len(names)} equal")
    return bad


if __name__ == "__main__":
    sys.exit(main())
