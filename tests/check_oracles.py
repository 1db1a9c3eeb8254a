"""Run every query beside its oracle on one data folder and print the differences.

    python tests/check_oracles.py [sf_dir] [query ...]
"""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


SPARK_TYPES = {"INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    """The given tables as DuckDB views."""
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(os.path.join(sf_dir, "*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def normalised(names: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    """Columns in order of name, rows in order of value."""
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    by_value = sorted(picked, key=lambda row: [(v is None, str(v)) for v in row])
    return [names[i] for i in order], by_value


def differences(spark_df, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """What differs between the two results, None if nothing does."""
    names, rows = normalised(spark_df.columns, [tuple(row) for row in spark_df.collect()])
    result = connection.execute(sql)
    expected_names, expected = normalised([d[0] for d in result.description], result.fetchall())
    if names != expected_names:
        return f"columns {names}, expected {expected_names}"
    types = dict(spark_df.dtypes)
    for name, kind, *_ in result.description:
        if types[name] != SPARK_TYPES.get(str(kind)):
            return f"{name} is {types[name]}, expected {kind}"
    if len(rows) != len(expected):
        return f"{len(rows)} rows, expected {len(expected)}"
    for row, other in zip(rows, expected):
        for a, b in zip(row, other):
            close = isinstance(a, float) and isinstance(b, float) and math.isclose(a, b, abs_tol=1e-9)
            if not (a == b or close) or type(a) is not type(b):
                return f"{row}, expected {other}"
    return None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from marquee.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = local_session("check", 8)
    spark.sparkContext.setLogLevel("ERROR")
    connection, expected = oracle(sf_dir), oracle_sql()
    for name, query in queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        start = time.time()
        try:
            df = query(spark, sf_dir)
            if name in expected:
                outcome = differences(df, connection, expected[name]) or "same"
            else:
                outcome = f"{df.count()} rows, no oracle"
        except Exception as error:  # noqa: BLE001 - report and go on
            outcome = f"FAILED {type(error).__name__}: {str(error)[:1500]}"
        print(f"{name:24} {time.time() - start:6.2f}s  {outcome}", flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
