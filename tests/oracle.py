"""Rows of a Spark query and of its DuckDB oracle in one comparable form."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return int(x) if x == x and abs(x) < 1e15 and x == int(x) else round(float(x), 9)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(sql: str, folder: str):
    con = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    names = sorted(columns)
    rows = [dict(zip(columns, r, strict=True)) for r in cursor.fetchall()]
    return names, sorted((tuple(plain(r[n]) for n in names) for r in rows), key=repr)
