"""Runs a query and its SQL over the same tables and compares the rows."""

import datetime as dt
import math
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if isinstance(x, dt.datetime):
        return x.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return x


def rows(names, data) -> list:
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in data), key=repr)


def compare(spark, con, query, sql: str, sf_dir: str) -> tuple[list, list]:
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    return mine, rows(names, found.fetchall())
