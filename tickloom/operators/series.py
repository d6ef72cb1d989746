"""The key of a bar series, and windows over it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

_keys: ContextVar[tuple[str, ...]] = ContextVar("keys", default=("symbol",))


def keys() -> tuple[str, ...]:
    """The columns that tell series apart; every operator works on all series at once."""
    return _keys.get()


@contextmanager
def keyed_by(*columns: str) -> Iterator[None]:
    """Plans made inside take these columns as the key: keyed_by("instrument_id", "timeframe")."""
    before = _keys.set(columns)
    try:
        yield
    finally:
        _keys.reset(before)


def of_series(*more: Column | str) -> WindowSpec:
    return Window.partitionBy(*keys(), *more)


def in_order(ts: str = "ts") -> WindowSpec:
    return of_series().orderBy(ts)


def so_far(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, 0)


def rolling(fn: Callable[[Column], Column], x: Column, n: int, w: WindowSpec) -> Column:
    """fn over the last n rows; null until n of them hold a value."""
    frame = w.rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) == n, fn(x).over(frame))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a, b)


def numbered(bars: DataFrame, ts: str = "ts") -> DataFrame:
    """bars with `n`, their place in the series from 1."""
    return bars.withColumn("n", F.row_number().over(in_order(ts)))


_ZERO = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"


def micros(ts: str = "ts") -> Column:
    """A time as microseconds on the clock it shows, whatever the session's zone."""
    return F.expr(f"timestampdiff(MICROSECOND, {_ZERO}, CAST(`{ts}` AS timestamp_ntz))")


def at_micros(name: str, kind: DataType) -> Column:
    """The inverse of micros() for a column, as a time of that type."""
    return F.expr(f"timestampadd(MICROSECOND, CAST(`{name}` AS bigint), {_ZERO})").cast(kind)
