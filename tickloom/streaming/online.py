"""Recurrences over streams of closed bars, with a state of fixed size per series.

Every recurrence is a machine that takes one bar at a time and whose state is a few doubles; a
stateful operator keeps the machines of a series as typed values in the state store. The rows
are those of the batch fold (operators/recurrence.py) over the same bars, whatever micro-batches
they come in and however often the stream restarts. One value needs the bar after it and cannot
be told when its bar closes: the PSAR of a series' first bar, which is null here.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from tickloom.operators.series import keys

NAN = math.nan
Bar = tuple[float, float, float]


def _over(a: float, b: float) -> float:
    return NAN if b == 0 else a / b


class Machine:
    """`fields` doubles of state, started by `start`; feed() takes (high, low, close) and gives the values of `made`."""

    made: tuple[str, ...]
    text: tuple[str, ...] = ()
    start: tuple[float, ...]

    def feed(self, state: list[float], bar: Bar) -> tuple:
        raise NotImplementedError


def _mean(state: list[float], at: int, x: float, alpha: float) -> float:
    """Exponential mean at state[at], the weight left to it at state[at + 1]: it decays over nulls."""
    value, weight = state[at], state[at + 1]
    if math.isnan(value):
        value = x
    else:
        weight *= 1 - alpha
        if not math.isnan(x):
            value, weight = (weight * value + alpha * x) / (weight + alpha), 1.0
    state[at : at + 2] = value, weight
    return value


_MEAN = (NAN, 1.0)
_WILDER = (0.0, 0.0, 0.0, NAN)


def _smooth(state: list[float], at: int, x: float, n: int) -> float:
    """Wilder's smoothing at state[at:at+4]: rows since the first value, known ones, their sum, the smoothed value. A null after the first n rows ends it."""
    rows, known, total, value = state[at : at + 4]
    if rows == 0 and math.isnan(x):
        return NAN
    rows += 1
    if rows <= n:
        if not math.isnan(x):
            known, total = known + 1, total + x
        value = total / known if rows == n else NAN
    else:
        value = value + (x - value) / n
    state[at : at + 4] = rows, known, total, value
    return value


def _range(state: list[float], at: int, bar: Bar) -> float:
    """True range; state[at] is the close before."""
    high, low, _ = bar
    known = [r for r in (high - low, abs(high - state[at]), abs(low - state[at])) if not math.isnan(r)]
    return max(known, default=NAN)


@dataclass(frozen=True)
class Ema(Machine):
    name: str
    span: int
    start = _MEAN

    @property
    def made(self) -> tuple[str, ...]:
        return (self.name,)

    def feed(self, state: list[float], bar: Bar) -> tuple:
        return (_mean(state, 0, bar[2], 2 / (self.span + 1)),)


@dataclass(frozen=True)
class Macd(Machine):
    fast: int = 12
    slow: int = 26
    signal: int = 9
    made = ("macd", "signal", "histogram")
    start = _MEAN * 3

    def feed(self, state: list[float], bar: Bar) -> tuple:
        line = _mean(state, 0, bar[2], 2 / (self.fast + 1)) - _mean(state, 2, bar[2], 2 / (self.slow + 1))
        mean = _mean(state, 4, line, 2 / (self.signal + 1))
        return line, mean, line - mean


@dataclass(frozen=True)
class Atr(Machine):
    name: str
    n: int
    start = (NAN, *_WILDER)

    @property
    def made(self) -> tuple[str, ...]:
        return (self.name,)

    def feed(self, state: list[float], bar: Bar) -> tuple:
        value = _smooth(state, 1, _range(state, 0, bar), self.n)
        state[0] = bar[2]
        return (value,)


@dataclass(frozen=True)
class Rsi(Machine):
    name: str
    n: int
    start = (NAN, *_WILDER, *_WILDER)

    @property
    def made(self) -> tuple[str, ...]:
        return (self.name,)

    def feed(self, state: list[float], bar: Bar) -> tuple:
        change = bar[2] - state[0]
        up, down = (change, -change) if math.isnan(change) else (max(change, 0.0), max(-change, 0.0))
        gain, loss = _smooth(state, 1, up, self.n), _smooth(state, 5, down, self.n)
        state[0] = bar[2]
        return (100.0 if loss == 0 else 100 - 100 / (1 + _over(gain, loss)),)


@dataclass(frozen=True)
class Adx(Machine):
    n: int
    made = ("adx", "plus_di", "minus_di")
    start = (NAN, NAN, NAN, *_WILDER, *_WILDER, *_WILDER, *_WILDER)

    def feed(self, state: list[float], bar: Bar) -> tuple:
        high, low, close = bar
        up, down = high - state[1], state[2] - low
        plus, minus = up if up > down and up > 0 else 0.0, down if down > up and down > 0 else 0.0
        width = _smooth(state, 3, _range(state, 0, bar), self.n)
        plus, minus = 100 * _over(_smooth(state, 7, plus, self.n), width), 100 * _over(_smooth(state, 11, minus, self.n), width)
        value = _smooth(state, 15, 100 * _over(abs(plus - minus), plus + minus), self.n)
        state[:3] = close, high, low
        return value, plus, minus


@dataclass(frozen=True)
class Psar(Machine):
    first: float = 0.02
    step: float = 0.02
    most: float = 0.2
    made = ("psar",)
    # bars so far, rising, extreme, stop, speed, then high and low of the two bars before, the older first
    start = (0.0, 0.0, NAN, NAN, NAN, NAN, NAN, NAN, NAN)

    def feed(self, state: list[float], bar: Bar) -> tuple:
        high, low, _ = bar
        seen, rising, point, stop, speed, high2, low2, high1, low1 = state
        if seen >= 1:
            if seen == 1:
                rising = high >= high1
                point, stop, speed = (high1, low1, self.first) if rising else (low1, high1, self.first)
            stop = stop + speed * (point - stop)
            before = ((low2, low1) if rising else (high2, high1))[0 if seen >= 2 else 1 :]
            stop = min(stop, *before) if rising else max(stop, *before)
            if (low < stop) if rising else (high > stop):
                rising, stop, speed = not rising, point, self.first
                point = high if rising else low
            elif (high > point) if rising else (low < point):
                point, speed = (high if rising else low), min(speed + self.step, self.most)
        state[:] = seen + 1, float(rising), point, stop, speed, high1, low1, high, low
        return (stop if seen >= 1 else NAN,)


@dataclass(frozen=True)
class SuperTrend(Machine):
    period: int
    times: float
    made = ("supertrend", "direction")
    text = ("direction",)
    # bars so far, rising, upper line, lower line, close before, then the smoothing
    start = (0.0, 0.0, NAN, NAN, NAN, *_WILDER)

    def feed(self, state: list[float], bar: Bar) -> tuple:
        high, low, close = bar
        seen, rising, top, bottom, before = state[:5]
        width = self.times * _smooth(state, 5, _range(state, 4, bar), self.period)
        upper, lower = (high + low) / 2 + width, (high + low) / 2 - width
        out: tuple = (NAN, "up")
        if seen == self.period:
            top, bottom, rising = upper, lower, close > lower
        elif seen > self.period:
            top = upper if upper < top or before > top else top
            bottom = lower if lower > bottom or before < bottom else bottom
            rising = not close < bottom if rising else close > top
        if seen >= self.period:
            out = (bottom, "up") if rising else (top, "down")
        state[:5] = seen + 1, float(rising), top, bottom, close
        return out


def folded(machines: Sequence[Machine], states: list[list[float]], high: Sequence[float], low: Sequence[float], close: Sequence[float]) -> dict[str, list]:
    """The columns that the machines make of these bars; `states` end as they are after the last."""
    made: dict[str, list] = {n: [] for m in machines for n in m.made}
    for bar in zip(high, low, close):
        for machine, state in zip(machines, states):
            for name, value in zip(machine.made, machine.feed(state, bar)):
                made[name].append(value)
    return made


class _Recurrences(StatefulProcessor):
    def __init__(self, machines: Sequence[Machine], of: Sequence[str]):
        self.machines, self.of = machines, of

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at bigint")
        self.values = [handle.getValueState(f"m{i}", StructType([StructField(f"x{k}", DoubleType()) for k in range(len(m.start))])) for i, m in enumerate(self.machines)]

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bars = pd.concat(list(rows)).sort_values("at", kind="stable").drop_duplicates("at", keep="last")
        if self.last.exists():
            bars = bars[bars["at"] > self.last.get()[0]]
        if bars.empty:
            return
        states = [[NAN if x is None else x for x in (v.get() if v.exists() else m.start)] for m, v in zip(self.machines, self.values)]
        made = folded(self.machines, states, *[bars[c].astype("float64").tolist() for c in ("high", "low", "close")])
        for v, s in zip(self.values, states):
            v.update(tuple(None if math.isnan(x) else float(x) for x in s))
        self.last.update((int(bars["at"].iloc[-1]),))
        yield pd.DataFrame({**dict(zip(self.of, key)), "at": bars["at"].to_numpy(), **made})

    def close(self) -> None:
        pass


def stream_recurrences(bars: DataFrame, *machines: Machine) -> DataFrame:
    """(key, ts, what the machines make) of every closed bar (key, ts, high, low, close) of a stream.

    Bars of a series must come in order over micro-batches; within one they are sorted. A bar not
    later than the series' last is left out, of two with one time the last counts. Null prices are
    taken as the batch fold takes them. The state store must be RocksDB.
    """
    of = keys()
    text = {n for m in machines for n in m.text}
    made = [StructField(n, StringType() if n in text else DoubleType()) for m in machines for n in m.made]
    told = StructType([*[bars.schema[k] for k in of], StructField("at", LongType()), *made])
    rows = bars.select(*of, F.unix_micros("ts").alias("at"), "high", "low", "close").groupBy(*of).transformWithStateInPandas(_Recurrences(machines, of), told, "Append", "None")
    return rows.select(*of, F.timestamp_micros("at").alias("ts"), *[n.name for n in made])
