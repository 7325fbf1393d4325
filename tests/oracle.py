"""Compares a Spark result with what DuckDB makes of a query's SQL on the same tables."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in sorted(os.listdir(sf_dir)):
        path = f"{sf_dir}/{f}"
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    """A value that compares equal however its engine types it."""
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (bool, int, float)) or hasattr(v, "as_integer_ratio"):
        return float(f"{float(v):.7g}")
    return str(v)


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


def of_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_sql(con, sql):
    found = con.execute(sql)
    return rows([d[0] for d in found.description], found.fetchall())
