"""Comparisons of Spark results with DuckDB and with plain rows."""

from __future__ import annotations

from pathlib import Path

import duckdb
import numpy as np
import pandas as pd


def run_sql(sql: str, folder: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con.execute(sql).df()


def canonical(df: pd.DataFrame) -> list[tuple]:
    """Rows as sorted tuples, columns by name, floats rounded and missing values alike."""

    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and np.isnan(v):
            return None
        if isinstance(v, (float, np.floating)):
            return round(float(v), 6) + 0.0
        if isinstance(v, (np.integer, np.bool_)):
            return v.item()
        if isinstance(v, (list, tuple, np.ndarray)):
            return tuple(plain(x) for x in v)
        return v

    columns = sorted(df.columns)
    rows = [tuple(plain(v) for v in row) for row in df[columns].itertuples(index=False)]
    return sorted(rows, key=lambda r: [(v is None, str(v)) for v in r])


def same_rows(spark_df, expected: pd.DataFrame) -> None:
    got = spark_df.toPandas()
    assert sorted(got.columns) == sorted(expected.columns)
    left, right = canonical(got), canonical(expected)
    assert len(left) == len(right)
    wrong = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    assert not wrong, wrong[:3]
