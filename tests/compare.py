"""Compare a query with its SQL in DuckDB: columns by name, rows as multisets, floats to 6 digits."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            db.execute(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return value


def rows_of_sql(db, sql: str) -> tuple[list[str], list[tuple]]:
    found = db.sql(sql)
    names = sorted(found.columns)
    at = [found.columns.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def rows_of_df(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    at = [df.columns.index(n) for n in names]
    return names, sorted((tuple(plain(r[i]) for i in at) for r in df.collect()), key=repr)
