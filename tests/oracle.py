"""Compares a query with its SQL, run by DuckDB over the same tables."""

import math
import os

DATA = os.environ.get("ORACLE_DATA", "/root/testdata/sf0.001")


def connect():
    import duckdb

    con = duckdb.connect()
    for f in sorted(os.listdir(DATA)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 4) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(spark, con, name, query, sql):
    df = query(spark, DATA)
    columns = sorted(df.columns)
    table = con.sql(sql).to_arrow_table()
    assert sorted(table.column_names) == columns, name
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    theirs = sorted((tuple(plain(r[c]) for c in columns) for r in table.to_pylist()), key=repr)
    assert mine == theirs, name
