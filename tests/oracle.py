"""Runs a query and its SQL twin over the same tables and compares them as bags of rows."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

DATA = "/root/testdata"


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in Path(sf_dir).iterdir():
        name = path.name.removesuffix(".parquet")
        files = f"{path}/*.parquet" if path.is_dir() else path
        con.execute(f"create view {name} as select * from read_parquet('{files}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 9)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return bytes(value) if isinstance(value, (bytearray, memoryview)) else value


def difference(spark, con, query, sql: str, sf_dir: str) -> str:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    ours = Counter(tuple(plain(v) for v in row) for row in df.select(*names).collect())
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != names:
        return f"columns {names} and {sorted(columns)}"
    order = [columns.index(n) for n in names]
    theirs = Counter(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
    if ours == theirs:
        return ""
    return f"{sum(ours.values())} rows, SQL {sum(theirs.values())}; only here {list((ours - theirs).items())[:3]}; only SQL {list((theirs - ours).items())[:3]}"
