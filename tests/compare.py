"""Rows of a Spark query against rows of its oracle SQL."""

import glob
import os

import duckdb
import pandas as pd


def connection(folder):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for p in glob.glob(folder + "/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def rows(frame, columns):
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and v != v:
            return "null"
        if isinstance(v, bool) or type(v).__name__ in ("bool_", "bool"):
            return str(bool(v))
        if isinstance(v, (int, float)) or hasattr(v, "dtype") and getattr(v, "ndim", 1) == 0:
            return f"{float(v):.9g}"
        return str([str(x) for x in v]) if hasattr(v, "__len__") and not isinstance(v, (str, dict)) else str(v)

    return sorted(tuple(one(v) for v in r) for r in frame[columns].itertuples(index=False))


def check(spark, con, folder, name, query, sql):
    a, b = query(spark, folder).toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns), name
    columns = sorted(a.columns)
    assert rows(a, columns) == rows(b, columns), name
