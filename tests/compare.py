"""Rows of Spark and of DuckDB in one form."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(frame) -> list[tuple[str, ...]]:
    frame = frame[sorted(frame.columns)]

    def cell(v) -> str:
        if isinstance(v, (str, bytes)):
            return str(v)
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return "null"
        try:
            return f"{float(v):.6f}"
        except (TypeError, ValueError):
            return str(v)

    return sorted(tuple(map(cell, r)) for r in frame.itertuples(index=False))
