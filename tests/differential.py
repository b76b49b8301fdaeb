"""Runs a query and its SQL over the same tables and compares rows and types."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb

SAME = {("bigint", "BIGINT"), ("string", "VARCHAR"), ("double", "DOUBLE"), ("int", "INTEGER"), ("boolean", "BOOLEAN")}


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def compare(spark, query, sql: str, folder: str) -> None:
    c = duckdb.connect()
    for p in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    df = query(spark, folder)
    result = c.execute(sql)
    names = [d[0] for d in result.description]
    cols = sorted(df.columns)
    assert cols == sorted(names)
    at = [names.index(x) for x in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    got = sorted((tuple(map(plain, r)) for r in df.select(*cols).collect()), key=repr)
    assert got == want
    kinds = dict(df.dtypes)
    types = {n: str(d[1]) for n, d in zip(names, result.description)}
    assert not [(x, kinds[x], types[x]) for x in cols if (kinds[x], types[x].upper()) not in SAME and types[x].upper() not in ("NUMBER", "STRING", "BOOL")]
