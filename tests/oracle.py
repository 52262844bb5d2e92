"""Compare a query's rows with those of its SQL counterpart."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    connection.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        file = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{file}'")
    return connection


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    done = [tuple(plain(row[i]) for i in order) for row in rows]
    return sorted(done, key=lambda row: tuple((v is not None, str(type(v)), v) for v in row))


def sql_rows(connection, sql: str) -> tuple[list[str], list[tuple], list[str]]:
    result = connection.execute(sql)
    columns = [d[0] for d in result.description]
    types = [str(d[1]) for d in result.description]
    return sorted(columns), rows_of(columns, result.fetchall()), [
        f"{c}:{t}" for c, t in sorted(zip(columns, types))
    ]


def spark_rows(frame) -> tuple[list[str], list[tuple]]:
    return sorted(frame.columns), rows_of(frame.columns, frame.collect())
