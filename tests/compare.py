"""Compares a query with its SQL on DuckDB: columns by name, rows in any order."""

import glob
import os

import duckdb
import numpy as np


def connect(sf_dir):
    con = duckdb.connect()
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        at = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"CREATE VIEW {os.path.basename(p).removesuffix('.parquet')} AS SELECT * FROM '{at}'")
    return con


def norm(v):
    if isinstance(v, float):
        return None if np.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (np.floating,)):
        return round(float(v), 6)
    return v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(norm(r[i]) for i in order) for r in values), key=repr), sorted(names)


def differences(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    got, names = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = connect(sf_dir).sql(sql)
    want, wanted = rows(rel.columns, rel.fetchall())
    assert names == wanted, (names, wanted)
    assert len(got) == len(want), (len(got), len(want), [x for x in got if x not in want][:3], [x for x in want if x not in got][:3])
    bad = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return bad
