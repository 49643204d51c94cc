"""A query's rows against those of its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb

DATA = Path("/root/testdata")


def _plain(v):
    if v is None or isinstance(v, (bool, str, bytes, int)):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9) + 0.0
    if isinstance(v, dict):
        return tuple(_plain(x) for x in v.values())
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return str(v)


def ordered(names, rows):
    at = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in at], sorted((tuple(_plain(r[i]) for i in at) for r in rows), key=repr)


def duck_rows(sql, sf="sf0.001", tables=None):
    con = duckdb.connect()
    for p in (DATA / sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    for name, frame in (tables or {}).items():
        con.execute(f"drop view if exists {name}")
        con.register(name, frame)
    found = con.execute(sql)
    return ordered([c[0] for c in found.description], found.fetchall())


def spark_rows(df):
    table = df.toArrow()
    columns = [c.to_pylist() for c in table.columns]
    return ordered(table.column_names, list(zip(*columns)) if columns else [])
