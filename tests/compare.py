"""Spark rows against DuckDB rows, whatever their order."""

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        at = f"{sf_dir}/{t}.parquet"
        if glob.glob(at):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}{'/*.parquet' if os.path.isdir(at) else ''}'")
    return c


def rows(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime"):
            df[c] = df[c].astype("datetime64[us]").astype(str)

    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or x != x:
            return None
        return int(x) if isinstance(x, float) and x.is_integer() else x

    return sorted(repr(tuple(map(plain, r))) for r in df.astype(object).itertuples(index=False, name=None))


def same(spark_df, sql, con):
    a, b = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows(a) == rows(b)
    return len(a)
