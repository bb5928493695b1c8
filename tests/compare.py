"""Row-wise comparison of a Spark result with DuckDB on the same Parquet files."""

from __future__ import annotations

import glob
import math
import os
from datetime import date, datetime
from decimal import Decimal

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _plain(value):
    if isinstance(value, bool):
        return value
    if isinstance(value, (float, Decimal)):
        value = float(value)
        if math.isnan(value):
            return "nan"
        return value + 0.0
    if isinstance(value, (datetime, date)):
        return value.isoformat()
    return value


def _sorted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    names = [columns[i] for i in order]
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return names, sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def spark_rows(df):
    return _sorted(df.columns, [tuple(r) for r in df.collect()])


def duck_rows(connection, sql):
    cursor = connection.execute(sql)
    return _sorted([d[0] for d in cursor.description], cursor.fetchall())


def difference(df, connection, sql) -> str | None:
    """None if both agree exactly, else a short account."""
    names, rows = spark_rows(df)
    oracle_names, oracle_rows = duck_rows(connection, sql)
    if names != oracle_names:
        return f"columns {names} != {oracle_names}"
    if len(rows) != len(oracle_rows):
        extra = list(dict.fromkeys(rows))[:3], list(dict.fromkeys(oracle_rows))[:3]
        return f"{len(rows)} rows != {len(oracle_rows)}; {extra}"
    for left, right in zip(rows, oracle_rows):
        if left != right or [type(v) for v in left] != [type(v) for v in right]:
            return f"columns {names}: spark {left} != oracle {right}"
    return None
