"""Spark results against DuckDB's."""

from __future__ import annotations

import duckdb

from tests.conftest import TABLES


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(x):
        if x is None or x != x:
            return None
        if hasattr(x, "tolist"):
            x = x.tolist()
        if isinstance(x, bool | int | str):
            return str(x)
        if isinstance(x, float):
            return repr(round(x, 6) + 0.0)
        if isinstance(x, list | tuple):
            return str([plain(y) for y in x])
        if hasattr(x, "isoformat"):
            return x.isoformat()
        return str(x)

    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=str)


def compare(spark, folder, query, sql):
    df = query(spark, folder)
    con = duckdb.connect()
    con.sql("set TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    got, expected = canon(df.columns, [tuple(r) for r in df.collect()]), canon(want.columns, want.fetchall())
    assert got == expected
    return got
