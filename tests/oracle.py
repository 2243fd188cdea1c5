"""Runs a query and its SQL counterpart and compares rows, columns and types."""

import os

import duckdb

TYPES = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}


def connect(sf_dir):
    con = duckdb.connect()
    for f in sorted(os.listdir(sf_dir)):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return con


def _plain(v):
    return f"{v:.9g}" if isinstance(v, float) else str(v)


def compare(spark, con, query, sql, sf_dir):
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    result = con.execute(sql)
    kinds = {d[0]: str(d[1]) for d in result.description}
    assert sorted(kinds) == columns
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == kinds
    place = [[d[0] for d in result.description].index(c) for c in columns]
    expected = sorted(tuple(_plain(r[i]) for i in place) for r in result.fetchall())
    assert sorted(tuple(_plain(r[c]) for c in columns) for r in df.collect()) == expected
    assert expected
