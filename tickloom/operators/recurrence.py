"""Recurrences over bar series: all that a query needs in one pass over each series.

What depends on the value before (exponential means, Wilder's smoothing, PSAR, SuperTrend) is
folded in one grouped Arrow map, whatever number of them is asked for. After windows over the
same key it needs no shuffle of its own. A series is in memory while it is folded: its bars are
bounded by time, not by the ticks they are made of.

Nulls: an exponential mean keeps its value over nulls while its weight decays; Wilder's
smoothing is started by the values that its first n rows hold, and is null from the first
null after these on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, NumericType, StringType, StructField, StructType

from tickloom.operators.series import keys

Arrays = dict[str, np.ndarray]


@dataclass(frozen=True)
class Step:
    """Columns `made` from the columns of a series; names in `text` hold strings, all others doubles."""

    made: tuple[str, ...]
    run: Callable[[Arrays], tuple[np.ndarray, ...]]
    text: tuple[str, ...] = ()


def fold(bars: DataFrame, *steps: Step, last: int | None = None) -> DataFrame:
    """bars, or the last so many of each series, with the columns of all steps; a later step may use what an earlier one made. Steps see every numeric column as doubles, decimals too."""
    made = [n for s in steps for n in s.made]
    text = {n for s in steps for n in s.text}
    kept = [c for c in bars.columns if c not in made]
    numeric = [f.name for f in bars.schema.fields if f.name in kept and isinstance(f.dataType, NumericType)]
    schema = StructType([*[bars.schema[c] for c in kept], *[StructField(n, StringType() if n in text else DoubleType()) for n in made]])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts")
        known = {c: table[c].cast(pa.float64(), safe=False).to_numpy().astype(np.float64) for c in numeric}
        for step in steps:
            known |= dict(zip(step.made, step.run(known)))
        columns = [pa.array(known[n], pa.string() if n in text else pa.float64(), from_pandas=True) for n in made]
        whole = pa.table([*table.columns, *columns], [*kept, *made])
        return whole if last is None else whole.slice(max(0, len(whole) - last))

    return bars.select(*kept).groupBy(*keys()).applyInArrow(run, schema)


def exponential(x: np.ndarray, span: int) -> np.ndarray:
    """Exponential mean, alpha 2 / (span + 1), started by the first value."""
    return pd.Series(x).ewm(span=span, adjust=False).mean().to_numpy()


def smoothed(x: np.ndarray, n: int) -> np.ndarray:
    """Wilder's smoothing: (before * (n - 1) + x) / n, started by a mean of n rows."""
    out = np.full(len(x), np.nan)
    there = np.flatnonzero(~np.isnan(x))
    if not len(there) or there[0] + n > len(x):
        return out
    at = there[0] + n - 1
    run = np.concatenate([[np.nanmean(x[there[0] : at + 1])], x[at + 1 :]])
    gaps = np.flatnonzero(np.isnan(run))
    run = run[: gaps[0]] if len(gaps) else run
    out[at : at + len(run)] = pd.Series(run).ewm(alpha=1 / n, adjust=False).mean()
    return out


def _before(x: np.ndarray) -> np.ndarray:
    return np.concatenate([[np.nan], x[:-1]])[: len(x)]


def _over(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a / b, NaN where b is 0."""
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


def true_range(a: Arrays) -> np.ndarray:
    close = _before(a["close"])
    return np.fmax(a["high"] - a["low"], np.fmax(np.abs(a["high"] - close), np.abs(a["low"] - close)))


def ema(name: str, x: str, span: int) -> Step:
    return Step((name,), lambda a: (exponential(a[x], span),))


def macd(fast: int, slow: int, signal: int) -> Step:
    def run(a: Arrays) -> tuple[np.ndarray, ...]:
        line = exponential(a["close"], fast) - exponential(a["close"], slow)
        mean = exponential(line, signal)
        return line, mean, line - mean

    return Step(("macd", "signal", "histogram"), run)


def atr(name: str, n: int) -> Step:
    return Step((name,), lambda a: (smoothed(true_range(a), n),))


def adx(n: int) -> Step:
    def run(a: Arrays) -> tuple[np.ndarray, ...]:
        up, down = a["high"] - _before(a["high"]), _before(a["low"]) - a["low"]
        plus, minus = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        width = smoothed(true_range(a), n)
        plus, minus = 100 * _over(smoothed(plus, n), width), 100 * _over(smoothed(minus, n), width)
        return smoothed(100 * _over(np.abs(plus - minus), plus + minus), n), plus, minus

    return Step(("adx", "plus_di", "minus_di"), run)


def rsi(name: str, n: int) -> Step:
    """100 where there are no losses, flat series included."""

    def run(a: Arrays) -> tuple[np.ndarray, ...]:
        change = a["close"] - _before(a["close"])
        gain, loss = smoothed(np.maximum(change, 0), n), smoothed(np.maximum(-change, 0), n)
        return (np.where(loss == 0, 100.0, 100 - 100 / (1 + _over(gain, loss))),)

    return Step((name,), run)


def psar(start: float, step: float, most: float) -> Step:
    """Parabolic SAR: a stop that speeds up with every new extreme and turns where it is met."""

    def run(a: Arrays) -> tuple[np.ndarray, ...]:
        high, low = a["high"].tolist(), a["low"].tolist()
        out = np.full(len(high), np.nan)
        if len(high) < 2:
            return (out,)
        rising = high[1] >= high[0]
        point, stop, speed = (high[0], low[0], start) if rising else (low[0], high[0], start)
        out[0] = stop
        for i in range(1, len(high)):
            stop = stop + speed * (point - stop)
            stop = min(stop, *low[max(0, i - 2) : i]) if rising else max(stop, *high[max(0, i - 2) : i])
            if (low[i] < stop) if rising else (high[i] > stop):
                rising, stop, speed = not rising, point, start
                point = high[i] if rising else low[i]
            elif (high[i] > point) if rising else (low[i] < point):
                point, speed = (high[i] if rising else low[i]), min(speed + step, most)
            out[i] = stop
        return (out,)

    return Step(("psar",), run)


def supertrend(period: int, times: float) -> Step:
    """SuperTrend: bands that ratchet, the side by the close against the bar's own bands. "up" without a line before row `period`."""

    def run(a: Arrays) -> tuple[np.ndarray, ...]:
        n = len(a["close"])
        line, way = np.full(n, np.nan), np.full(n, "up", object)
        middle, width = (a["high"] + a["low"]) / 2, times * smoothed(true_range(a), period)
        tops, bottoms, close = (middle + width).tolist(), (middle - width).tolist(), a["close"].tolist()
        top = bottom = rising = None
        for i in range(period, n):
            if top is None:
                top, bottom = tops[i], bottoms[i]
                rising = close[i] > bottom
            else:
                if tops[i] < top or close[i - 1] > top:
                    top = tops[i]
                if bottoms[i] > bottom or close[i - 1] < bottom:
                    bottom = bottoms[i]
                rising = not close[i] < bottom if rising else close[i] > top
            line[i], way[i] = (bottom, "up") if rising else (top, "down")
        return line, way

    return Step(("supertrend", "direction"), run, ("direction",))


def from_end() -> Step:
    """`back`: 1 for the last bar, 2 for the one before, and so on."""
    return Step(("back",), lambda a: (np.arange(len(next(iter(a.values()))), 0, -1).astype(np.float64),))
