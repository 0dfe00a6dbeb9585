"""Compares a query with its SQL on DuckDB."""

import math
import os

import duckdb

from corpuscle.session import TABLES


def connection(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return ""
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v) + 0.0:.9g}"
    return str(v)


def rows(names: list, data: list) -> list:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


def compare(df, sql: str, sf_dir: str) -> None:
    got = df.collect()
    c = connection(sf_dir).execute(sql)
    names = [d[0] for d in c.description]
    assert sorted(df.columns) == sorted(names)
    want = rows(names, c.fetchall())
    assert rows(df.columns, got) == want
