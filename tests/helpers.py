"""Plain versions to compare with, and small makers of tables."""

from __future__ import annotations

import math

DATA = "/root/testdata"


def rows(df) -> set:
    """The rows of a frame as a set of tuples in the order of its columns."""
    return {tuple(r) for r in df.collect()}


def same(x):
    """A value that compares equal to itself and across libraries."""
    if isinstance(x, (list, tuple)):
        return tuple(same(v) for v in x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    return x


def duckdb_rows(sql: str, sf: str, columns: list[str]):
    import os

    import duckdb

    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(f"{DATA}/{sf}"):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{sf}/{f}'")
    r = c.execute(sql)
    names = [d[0] for d in r.description]
    at = [names.index(x) for x in columns]
    return sorted((tuple(same(row[i]) for i in at) for row in r.fetchall()), key=repr)


def spark_rows(df):
    columns = sorted(df.columns)
    return columns, sorted((tuple(same(r[c]) for c in columns) for r in df.collect()), key=repr)
