"""Compare queries with their SQL in DuckDB, as multisets of rows."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os

import duckdb


def rows_of(table) -> list[tuple]:
    return sorted(table, key=repr)


def value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None)
    return v


def duck(sf_dir: str, statement: str) -> tuple[list[str], list[tuple]]:
    c = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(p).removesuffix(".parquet")
        c.execute(f"create view {name} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    out = c.execute(statement)
    names = [x[0] for x in out.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], rows_of([tuple(value(r[i]) for i in order) for r in out.fetchall()])


def spark_rows(df) -> tuple[list[str], list[tuple]]:
    names = sorted(df.columns)
    return names, rows_of([tuple(value(r[n]) for n in names) for r in df.collect()])
