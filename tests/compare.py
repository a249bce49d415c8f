"""Compare a Spark result with its SQL twin in DuckDB, row for row."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(frame: pd.DataFrame) -> pd.DataFrame:
    """Columns by name; numbers as floats, everything else as text; rows sorted."""
    out = {}
    for c in sorted(frame.columns):
        s = frame[c]
        if pd.api.types.is_bool_dtype(s.dtype):
            out[c] = s.astype(object).map(lambda x: None if pd.isna(x) else str(bool(x)))
        elif pd.api.types.is_numeric_dtype(s.dtype):
            out[c] = s.astype("Float64").astype("float64")
        elif pd.api.types.is_datetime64_any_dtype(s.dtype):
            out[c] = s.dt.strftime("%Y-%m-%d %H:%M:%S").where(s.notna(), None)
        else:
            sample = s.dropna()
            if len(sample) and hasattr(sample.iloc[0], "isoformat"):
                s = pd.to_datetime(s)
                out[c] = s.dt.strftime("%Y-%m-%d %H:%M:%S").where(s.notna(), None)
            else:
                out[c] = s.where(s.notna(), None).map(lambda x: x if x is None else str(x))
    result = pd.DataFrame(out)
    return result.sort_values(list(result.columns), na_position="first").reset_index(drop=True)


def difference(spark_rows: pd.DataFrame, sql_rows: pd.DataFrame) -> str | None:
    """None when equal, else what differs first."""
    if sorted(spark_rows.columns) != sorted(sql_rows.columns):
        return f"columns {sorted(set(spark_rows.columns) ^ set(sql_rows.columns))}"
    if len(spark_rows) != len(sql_rows):
        return f"rows {len(spark_rows)} != {len(sql_rows)}"
    a, b = plain(spark_rows), plain(sql_rows)
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = (~same).idxmax()
            return f"{c}: {(~same).sum()} differ, first {a[c][i]!r} != {b[c][i]!r}"
    return None
