"""Runs a query in Spark and its SQL twin in DuckDB and compares the rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(sf_dir, f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, float):
        return f"{x:.6g}" if abs(x) > 1e9 else round(x, 5) + 0.0
    return x.isoformat() if hasattr(x, "isoformat") else x.item() if hasattr(x, "item") else x


def rows(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(v) for v in row]) for row in frame.astype(object).itertuples(index=False))


def difference(spark: SparkSession, sf_dir: str, query, sql: str, con: duckdb.DuckDBPyConnection) -> str:
    """What differs; "" if nothing does."""
    got, want = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows, first {bad[0]}" if bad else ""
