"""Run a registered query and its SQL on the same tables and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

from markspan.sources.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in rows), key=repr)


def spark_rows(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cur = con.execute(sql)
    return rows_of([d[0] for d in cur.description], cur.fetchall()), [(d[0], str(d[1])) for d in cur.description]


SQL_TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP", "date": "DATE", "float": "FLOAT",
}


def differences(df, con, sql, show: int = 3):
    """None when equal, else a short description."""
    mine, (theirs, columns) = spark_rows(df), sql_rows(con, sql)
    if sorted(df.columns) != sorted(c for c, _ in columns):
        return f"columns {sorted(df.columns)} / {sorted(c for c, _ in columns)}"
    types = dict(columns)
    wrong = [(c, t, types[c]) for c, t in df.dtypes if SQL_TYPES.get(t) != types[c]]
    if mine == theirs:
        return f"types {wrong}" if wrong else None
    held_here, held_there = set(mine), set(theirs)
    only_mine, only_theirs = [r for r in mine if r not in held_there], [r for r in theirs if r not in held_here]
    return f"rows {len(mine)} / {len(theirs)}; only here {only_mine[:show]}; only there {only_theirs[:show]}; types {df.dtypes} / {columns}"
