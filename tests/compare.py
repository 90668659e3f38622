"""Rows of a query against those of its SQL."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 7)
    return [plain(x) for x in v] if isinstance(v, list) else v


def assert_same(con, df, sql):
    columns = sorted(df.columns)
    got = sorted(tuple(str(plain(r[c])) for c in columns) for r in df.collect())
    result = con.sql(sql)
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    want = sorted(tuple(str(plain(r[i])) for i in at) for r in result.fetchall())
    assert got == want
