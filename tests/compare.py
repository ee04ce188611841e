"""Comparing a query's rows with those of its SQL on DuckDB."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    if isinstance(value, bool):
        return value
    if hasattr(value, "__index__"):
        return int(value)
    if isinstance(value, float):
        return round(value, 6)
    return str(value)


def rows(names, records):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in records)


def assert_same(df, sql, sf_dir):
    result = connect(sf_dir).execute(sql)
    names = [d[0] for d in result.description]
    assert sorted(names) == sorted(df.columns)
    assert rows(df.columns, df.collect()) == rows(names, result.fetchall())
