"""Runs SQL over the tables of a folder and brings rows into one form."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql(folder: str, text: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p if os.path.isfile(p) else p + '/*.parquet'}'")
    return con.execute(text).df()


def _plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, pd.Timestamp):
        return str(v.to_datetime64())[:26]
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(_plain(v) for v in r) for r in df.astype(object).itertuples(index=False, name=None)), key=str)
