"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf_dir: str, sql: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.sql(sql)


def normal(x):
    if isinstance(x, float):
        return round(x, 6)
    return x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x


def differences(spark, sf_dir: str, run, sql: str):
    """Rows that only one side has, column names first."""
    df, want = run(spark, sf_dir), oracle(sf_dir, sql)
    a, b = sorted(df.columns), sorted(want.columns)
    if a != b:
        return {"columns": (a, b)}
    got = Counter(tuple(normal(r[c]) for c in a) for r in df.collect())
    order = [want.columns.index(c) for c in b]
    exp = Counter(tuple(normal(r[i]) for i in order) for r in want.fetchall())
    return {"got": list((got - exp).items())[:3], "want": list((exp - got).items())[:3]} if got != exp else {"rows": sum(got.values())} if not got else {}
