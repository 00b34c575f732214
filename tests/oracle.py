"""Compares a query with its SQL on DuckDB: columns, row counts, sorted rows."""

import os

import duckdb

from tessera.sources.fixtures import TABLES


def connection(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        c.execute(f"create view {t} as select * from read_parquet('{path}/*.parquet')" if os.path.isdir(path) else f"create view {t} as select * from read_parquet('{path}')")
    return c


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows(data, columns, order):
    at = [columns.index(c) for c in order]
    return sorted((tuple(plain(r[k]) for k in at) for r in data), key=repr)


def same(spark, sf_dir, query, sql, con):
    df = query(spark, sf_dir)
    got = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(got, df.columns, sorted(names)) == rows(cursor.fetchall(), names, sorted(names))
    return len(got)
