"""The registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.sources import bars as src

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def told(df: DataFrame, *columns: str) -> DataFrame:
    """The columns, doubles rounded to six places."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(F.col(c), 6).alias(c) if kinds[c] == "double" else F.col(c) for c in columns])


def register(name: str, twin: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if twin is not None:
            ORACLE_SQL[name] = twin
        return fn

    return add


def on_bars(name: str, twin: str | None, make: Callable[[DataFrame], DataFrame], *columns: str, source: Query = src.brand_week, branches: bool = False) -> None:
    """A query over the bars of one source. Where the plan branches over them, the bars (far smaller than the ticks) are cached, so the ticks are read once."""
    given = (lambda spark, sf_dir: source(spark, sf_dir).cache()) if branches else source
    register(name, twin)(lambda spark, sf_dir: told(make(given(spark, sf_dir)), *columns))


def column(name: str, twin: str, make: Callable[[], Column], *, source: Query = src.brand_week) -> None:
    """A query that adds one column to the bars."""
    on_bars(name, twin, lambda b: b.withColumn(name, make()), "symbol", "ts", name, source=source)
