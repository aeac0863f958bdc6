"""Compares a query's rows with its SQL in DuckDB."""

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}{'/*.parquet' if os.path.isdir(f) else ''}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    return float(f"{v:.9g}") if isinstance(v, float) else v


def same_rows(df, con, sql: str) -> None:
    cols = sorted(df.columns)
    ours = sorted(([plain(r[c]) for c in cols] for r in df.collect()), key=repr)
    rel = con.sql(sql)
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    theirs = sorted(([plain(r[k]) for k in at] for r in rel.fetchall()), key=repr)
    assert ours == theirs
