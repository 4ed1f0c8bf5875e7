"""Compare a query with its DuckDB oracle."""

import datetime
import decimal
import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        path = f if os.path.isfile(f) else f"{f}/*.parquet"
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(v):
    if v is None or isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return v.isoformat()
    return str(v)


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(tuple(norm(r[c]) for c in columns) for r in df.collect())


def oracle_rows(con, sql):
    found = con.sql(sql)
    columns = sorted(found.columns)
    places = [found.columns.index(c) for c in columns]
    return columns, sorted(tuple(norm(r[k]) for k in places) for r in found.fetchall())
