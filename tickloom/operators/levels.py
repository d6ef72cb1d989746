"""Support and resistance levels, each series in one grouped map: clusters of swings, and levels that bars, weeks, means, profiles and round numbers give."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.operators.latest import only_extreme, profile
from tickloom.operators.recurrence import Arrays, exponential, smoothed, true_range
from tickloom.operators.series import at_micros, keys, micros

# The weight of a timeframe in a cluster's strength, and the strengths of the other levels.
TIMEFRAME_WEIGHTS = {"1m": 20, "5m": 30, "15m": 40, "1h": 55, "4h": 70, "1d": 85, "1w": 100}
OTHER_TIMEFRAME = 50
STRENGTHS = {"ema50": 55, "ema200": 60, "round_number": 50, "pivot_daily": 65, "pivot_weekly": 70, "high_52w": 80, "low_52w": 80, "poc": 75}
_DAY = 86_400_000_000
_FIELDS = "source string, price double, strength double, touches bigint, volume bigint, wick double, first_us bigint, last_us bigint, close double, role_flipped boolean"


def _scaled(x: np.ndarray) -> np.ndarray:
    lo, hi = x.min(), x.max()
    return np.full(len(x), 50.0) if lo == hi else 100.0 * (x - lo) / (hi - lo)


def _clusters(a: Arrays, us: np.ndarray, weight: float) -> list[tuple]:
    """The swings of these bars, chained by price within half an ATR: (source, price, strength, touches, volume, wick, first, last)."""
    width = smoothed(true_range(a), 14)
    tolerance = 0.5 * width[-1] if len(width) and not np.isnan(width[-1]) else 0.0
    found = []
    for side, (of, sign) in enumerate((("low", 1), ("high", -1))):
        for i in np.flatnonzero(only_extreme(a[of], 5, of == "high")):
            body = np.fmin(a["open"][i], a["close"][i]) if of == "low" else np.fmax(a["open"][i], a["close"][i])
            found.append((a[of][i], int(us[i]), side, sign * (body - a[of][i]), a["volume"][i]))
    if not found:
        return []
    found.sort(key=lambda x: x[:3])
    price = np.array([x[0] for x in found])
    starts = np.flatnonzero(np.concatenate([[True], np.diff(price) > tolerance]))
    groups = [found[i:j] for i, j in zip(starts, [*starts[1:], len(found)])]
    touches = np.array([float(len(g)) for g in groups])
    volume = np.array([np.nansum([x[4] for x in g]) for g in groups])
    wick = np.array([np.nanmean([x[3] for x in g]) for g in groups])
    last = np.array([max(x[1] for x in g) for g in groups])
    days = np.maximum(0.0, (us.max() - last) / _DAY)
    strength = 0.30 * _scaled(touches) + 0.25 * _scaled(volume) + 0.20 * 100 * np.exp(-days / 60) + 0.15 * _scaled(wick) + 0.10 * weight
    return [("swing", float(np.mean([x[0] for x in g])), float(s), len(g), int(v), float(w), min(x[1] for x in g), int(z)) for g, s, v, w, z in zip(groups, strength, volume, wick, last)]


def _pivot(source: str, high: float, low: float, close: float) -> list[tuple[str, float]]:
    pp = (high + low + close) / 3
    return [(f"{source}_pp", pp), (f"{source}_r1", 2 * pp - low), (f"{source}_s1", 2 * pp - high)]


def _week_before(a: Arrays, us: np.ndarray) -> tuple[float, float, float] | None:
    """High, low and close of the week before the last that has a complete bar; weeks begin on Monday."""
    whole = ~np.isnan(a["open"] + a["high"] + a["low"] + a["close"])
    week = ((us // _DAY) + 3) // 7
    weeks = np.unique(week[whole])
    if len(weeks) < 2:
        return None
    own = np.flatnonzero(whole & (week == weeks[-2]))
    return a["high"][own].max(), a["low"][own].min(), a["close"][own[-1]]


def _others(a: Arrays, us: np.ndarray) -> list[tuple]:
    n, close, now = len(us), a["close"][-1], int(us[-1])
    found: list[tuple[str, float]] = []
    for span in (50, 200):
        if n >= span:
            found.append((f"ema{span}", exponential(a["close"], span)[-1]))
    step = 50.0 if close < 1000 else 100.0 if close < 10_000 else 500.0
    found += [("round_number", np.rint(close / step) * step + k * step) for k in range(-2, 3)]
    if n >= 2:
        found += _pivot("pivot_daily", a["high"][-2], a["low"][-2], a["close"][-2])
    week = _week_before(a, us)
    if week is not None:
        found += _pivot("pivot_weekly", *week)
    for source, x, best in (("high_52w", a["high"][-252:], np.nanmax), ("low_52w", a["low"][-252:], np.nanmin)):
        found += [(source, best(x))] if not np.isnan(x).all() else []
    found.append(("poc", profile().run(a)[0][-1]))
    strength = lambda s: float(STRENGTHS[s.rsplit("_", 1)[0] if s.startswith("pivot") else s])
    return [(s, float(p), strength(s), 0, None, None, now, now) for s, p in found if not np.isnan(p)]


def every_level(bars: DataFrame, timeframe: str = "1w", last: int = 250) -> DataFrame:
    """(key, source, price, strength, touches, volume, wick, first_seen, last_tested, close, role_flipped) of all levels of each series, whatever their strength.

    Swings come from the last bars, the others from the whole series; `close` is its last one, and
    role_flipped tells whether one of the 20 closes before stood on the other side of the level.
    """
    of = list(keys())
    kind = bars.schema["ts"].dataType
    weight = TIMEFRAME_WEIGHTS.get(timeframe, OTHER_TIMEFRAME)
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    schema = StructType([*[bars.schema[k] for k in of], *StructType.fromDDL(_FIELDS).fields])

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("us")
        us = table["us"].to_numpy()
        a = {c: table[c].to_numpy() for c in ("open", "high", "low", "close", "volume")}
        with np.errstate(invalid="ignore", divide="ignore"):
            rows = _clusters({c: x[-last:] for c, x in a.items()}, us[-last:], weight) + _others(a, us)
            close = a["close"][-1]
            seen = a["close"][-21:-1]
            flipped = [bool(((seen > r[1]) != (close > r[1]))[~np.isnan(seen)].any()) and not np.isnan(close) for r in rows]
        columns = [*zip(*rows)] if rows else [()] * 8
        made = [pa.array(list(x), t) for x, t in zip([*columns, [None if np.isnan(close) else close] * len(rows), flipped], [pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()])]
        return pa.table([*[pa.array([table[k][0].as_py()] * len(rows), table[k].type) for k in of], *made], [*of, *names])

    slim = bars.select(*of, micros().alias("us"), *[F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")])
    rows = slim.groupBy(*of).applyInArrow(run, schema)
    return rows.select(*of, *names[:6], *[at_micros(f"{c}_us", kind).alias(n) for c, n in (("first", "first_seen"), ("last", "last_tested"))], "close", "role_flipped")
