"""Comparison of a registered query with its SQL on DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"create view {name} as select * from '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float) and not math.isfinite(value):
        return repr(value)
    return value


def _table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    body = [tuple(_cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(body, key=lambda row: [(v is None, str(type(v)), v) for v in row])


def difference(df, connection: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    """First difference between the frame and the SQL result, None when they agree."""
    columns, rows = _table(df.columns, [tuple(row) for row in df.collect()])
    result = connection.execute(sql)
    wanted_columns, wanted = _table([d[0] for d in result.description], result.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} / {wanted_columns}"
    if len(rows) != len(wanted):
        extra, missing = set(rows) - set(wanted), set(wanted) - set(rows)
        return f"rows {len(rows)} / {len(wanted)}; extra {sorted(extra, key=str)[:2]}; missing {sorted(missing, key=str)[:2]}"
    for mine, theirs in zip(rows, wanted, strict=True):
        if mine != theirs or [type(v) for v in mine] != [type(v) for v in theirs]:
            return f"{columns}\n  {mine}\n  {theirs}"
    return None
