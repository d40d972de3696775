"""Compare a query's result with DuckDB's, regardless of the order of rows and of columns."""

import os

import duckdb
import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}/*.parquet'" if os.path.isdir(path) else f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con.sql(sql).df()


def _plain(v) -> str:
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, (float, np.floating)) and np.isnan(v):
        return "null"
    return repr(float(v)) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, bool) else str(v)


def canonical(df: pd.DataFrame) -> list[tuple[str, ...]]:
    cols = sorted(df.columns)
    return sorted(tuple(_plain(v) for v in row) for row in df[cols].itertuples(index=False, name=None))


def assert_same(got: pd.DataFrame, want: pd.DataFrame) -> None:
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got), canonical(want)
    assert len(a) == len(b)
    assert a == b, next((x, y) for x, y in zip(a, b, strict=True) if x != y)
