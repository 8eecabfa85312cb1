"""Holds a DataFrame against the rows of its SQL twin."""

import decimal
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        path = Path(folder, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return round(value, 6) if math.isfinite(value) else str(value)
    return value


def rows_of(df):
    names = sorted(df.columns)
    return sorted(([plain(r[n]) for n in names] for r in df.collect()), key=str)


def rows_of_sql(con, sql):
    found = con.sql(sql)
    order = sorted(range(len(found.columns)), key=lambda i: found.columns[i])
    return [found.columns[i] for i in order], sorted(([plain(r[i]) for i in order] for r in found.fetchall()), key=str)
