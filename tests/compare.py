"""Rows of a query and of its SQL, made comparable."""

import glob
import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def _cell(x) -> str:
    if hasattr(x, "__len__") and not isinstance(x, str):
        return str([_cell(y) for y in x])
    if pd.isna(x):
        return "null"
    if isinstance(x, float):
        return str(int(x)) if x.is_integer() else repr(round(x, 6))
    return str(x).removesuffix(" 00:00:00")


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(_cell(x) for x in r) for r in df.itertuples(index=False)), list(df.columns)
