"""Compares a query with its oracle SQL in DuckDB, row by row, whatever the order of rows."""

import math
from pathlib import Path

import duckdb

BASES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for name in BASES:
        path = Path(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)):
        return float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if hasattr(x, "item"):
        return plain(x.item())
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, sf_dir, query, sql):
    df = query(spark, sf_dir)
    got_columns, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_columns, want = rows_of([d[0] for d in result.description], result.fetchall())
    if got_columns != want_columns:
        return f"columns {got_columns} instead of {want_columns}"
    if got != want:
        return f"{len(got)} rows instead of {len(want)}; only here: {[r for r in got if r not in want][:3]}; only there: {[r for r in want if r not in got][:3]}"
    return ""
