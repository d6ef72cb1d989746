"""The signal engine bar by bar, and its backtest: one fold per series, so one shuffle and one sort.

At bar t the engine sees [0..t] only. It scores the bar, and from its close, swings and ranges it
plans a limit, a stop and three targets; the same plan serves the last bar of a live series and
every bar of a backtest.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.functions.tick import BANDS, LARGEST_TICK
from tickloom.operators import recurrence as rec
from tickloom.operators.recurrence import Arrays, Step, fold
from tickloom.operators.relational import FACTORS, MODES, SCALE_OUT
from tickloom.operators.series import at_micros, keys, micros

# Bars back for the swing low, slippage, and the chandelier of each mode.
LOOKBACK = {"scalping": 10, "day": 20, "swing": 40, "investing": 60}
SLIPPAGE = {"scalping": 0.002, "day": 0.001, "swing": 0.001, "investing": 0.001}
TRAIL = {"scalping": (10, 2.0), "day": (10, 2.0), "swing": (22, 3.0), "investing": (22, 3.0)}
ENTRY_FEE, EXIT_FEE = 0.0015, 0.0025
BUY = 65.0


def on_tick(price: np.ndarray) -> np.ndarray:
    """Prices rounded down to the tick of their own size; NaN for those not above 0."""
    p = np.round(price, 4)
    tick = np.select([p < below for below, _ in BANDS], [float(t) for _, t in BANDS], float(LARGEST_TICK))
    return np.where(p > 0, np.floor(p / tick) * tick, np.nan)


def _rolled(x: np.ndarray, n: int, how: str) -> np.ndarray:
    """Over the last n rows; NaN until n of them are known."""
    return getattr(pd.Series(x).rolling(n, min_periods=n), how)().to_numpy()


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of the last n rows, of as many as there are."""
    return pd.Series(x).rolling(n, min_periods=1).min().to_numpy()


def _zero(x: np.ndarray) -> np.ndarray:
    return np.where(np.isnan(x), 0.0, x)


def score(mode: str) -> Step:
    """`trend`, `momentum`, `volume_score`, `structure` (each 0 to 100) and `score`, their mean by the mode's weights; what is unknown counts as 0.

    trend: as trend_score(); momentum: RSI; volume_score: 50 times the relative volume, 100 at
    most; structure: where the close lies between the low and the high of the last 20 bars.
    """
    weights = MODES[mode]
    total = sum(weights[f] for f in FACTORS)

    def run(a: Arrays) -> tuple[np.ndarray, ...]:
        with np.errstate(invalid="ignore", divide="ignore"):
            trend = 20.0 * (a["close"] > a["ema20"]) + 20.0 * (a["ema20"] > a["ema50"]) + 20.0 * (a["ema50"] > a["ema200"])
            trend = trend + np.select([a["adx"] > 25, a["adx"] > 20], [20.0, 10.0], 0.0) + 20.0 * (a["direction"] == "up")
            usual = _rolled(a["volume"], 20, "mean")
            volume = np.minimum(100.0, 50.0 * np.where(usual == 0, np.nan, a["volume"] / usual))
            high, low = _rolled(a["high"], 20, "max"), _rolled(a["low"], 20, "min")
            structure = np.where(high == low, np.nan, 100.0 * (a["close"] - low) / (high - low))
        made = {"trend": trend, "momentum": a["rsi"], "volume": volume, "structure": structure}
        mean = sum(_zero(x) * (weights[f] / total) for f, x in made.items())
        return trend, a["rsi"], volume, structure, mean

    return Step(("trend", "momentum", "volume_score", "structure", "score"), run)


def plan(mode: str) -> Step:
    """`limit` a quarter of an ATR below the close, `stop` (the tightest of swing low less half an ATR, k ATR, largest risk), `tp1` to `tp3` by multiples of the risk, `trail` (chandelier): all on ticks, rounded down, but for the trail."""
    m, (bars, times) = MODES[mode], TRAIL[mode]

    def run(a: Arrays) -> tuple[np.ndarray, ...]:
        limit = on_tick(a["close"] - 0.25 * a["atr"])
        swing = _least(a["low"], LOOKBACK[mode])
        stop = on_tick(np.maximum(np.maximum(swing - 0.5 * a["atr"], limit - m["k_atr"] * a["atr"]), limit * (1 - m["max_risk"])))
        targets = [on_tick(limit + r * (limit - stop)) for r in m["tp"]]
        return limit, stop, *targets, _rolled(a["high"], bars, "max") - times * a["trail_atr"]

    return Step(("limit", "stop", "tp1", "tp2", "tp3", "trail"), run)


def signal_steps(mode: str) -> tuple[Step, ...]:
    """What score() and plan() need, then they."""
    needed = [rec.ema(f"ema{n}", "close", n) for n in (20, 50, 200)] + [rec.adx(14), rec.supertrend(10, 3.0), rec.rsi("rsi", 14), rec.atr("atr", 14), rec.atr("trail_atr", TRAIL[mode][0])]
    return (*needed, score(mode), plan(mode))


def signals(bars: DataFrame, mode: str) -> DataFrame:
    """(key, ts, trend, momentum, volume_score, structure, score, limit, stop, tp1, tp2, tp3) of every bar."""
    rows = fold(bars.select(*keys(), "ts", "open", "high", "low", "close", F.col("volume").cast("double").alias("volume")), *signal_steps(mode))
    return rows.select(*keys(), "ts", "trend", "momentum", "volume_score", "structure", "score", "limit", "stop", "tp1", "tp2", "tp3")


def trades(mode: str, least: float, shares: Sequence[float], entry_fee: float, exit_fee: float) -> Step:
    """The trades of a series, each on the bar that ends it: `entered` (microseconds), `bought`, `sold` (mean by shares), `return`, `r`, `targets` (hit)."""
    slip = SLIPPAGE[mode]

    def run(a: Arrays) -> tuple[np.ndarray, ...]:
        n = len(a["close"])
        out = np.full((6, n), np.nan)
        names = ("open", "high", "low", "limit", "stop", "tp1", "tp2", "tp3", "trail", "score", "us")
        o, h, l, limit, stop, t1, t2, t3, trail, rated, us = (a[c].tolist() for c in names)
        held = None
        for i in range(1, n):
            if held is None:
                j = i - 1
                if not (rated[j] >= least and limit[j] > stop[j] and l[i] <= limit[j] and o[i] > stop[j]):
                    continue
                held, price, safe, targets, hit, left, got = i, min(o[i], limit[j]) * (1 + slip), stop[j], (t1[j], t2[j], t3[j]), 0, 1.0, 0.0
                risk = price - safe
            elif hit >= 1:
                # the stop moves with what was known when the bar before closed
                safe = max(safe, price, trail[i - 1]) if hit >= 2 and trail[i - 1] == trail[i - 1] else max(safe, price)
            if l[i] <= safe:
                got += left * min(o[i], safe) * (1 - slip)
                left = 0.0
            elif i > held:
                while hit < 3 and h[i] >= targets[hit]:
                    part = shares[hit] if hit < 2 else left
                    got += part * max(o[i], targets[hit]) * (1 - slip)
                    left -= part
                    hit += 1
                if hit == 3:
                    left = 0.0
            if left == 0.0:
                paid = price * (1 + entry_fee)
                out[:, i] = us[held], price, got, (got * (1 - exit_fee) - paid) / paid, (got - price) / risk, hit
                held = None
        return tuple(out)

    return Step(("entered", "bought", "sold", "return", "r", "targets"), run)


def signal_backtest(bars: DataFrame, mode: str = "swing", *, least: float = BUY, shares: Sequence[float] = SCALE_OUT, entry_fee: float = ENTRY_FEE, exit_fee: float = EXIT_FEE, split: float = 0.2) -> DataFrame:
    """(key, entry_ts, exit_ts, entry, exit, return, r, targets, held_out) of the engine's trades, long only.

    A bar whose score is `least` or more places a limit for the next bar, which fills if that
    bar's low reaches it and it does not open at or below the stop: at the limit or, if the bar
    opens lower, at the open. `shares` of the position are sold at the first and the second target
    and the rest at the third; from the bar after the first on the stop is the entry, from the
    bar after the second on also the chandelier trail of the bar before. A bar that touches both
    stop and target ends at the stop; a gap through the stop fills at the open; on the bar of
    the entry only the stop counts. Slippage is the mode's, on each fill. A position that is open
    at the end is no trade. held_out: entered in the last `split` of the series' bars.
    """
    rows = bars.select(*keys(), "ts", "open", "high", "low", "close", F.col("volume").cast("double").alias("volume"), micros().alias("us"))
    told = fold(rows, *signal_steps(mode), trades(mode, least, shares, entry_fee, exit_fee), _late(split))
    entered = at_micros("entered", bars.schema["ts"].dataType)
    kept = told.filter(F.col("entered").isNotNull())
    return kept.select(*keys(), entered.alias("entry_ts"), F.col("ts").alias("exit_ts"), F.col("bought").alias("entry"), F.col("sold").alias("exit"), "return", "r", F.col("targets").cast("int").alias("targets"), (F.col("entered") >= F.col("split_us")).alias("held_out"))


def _late(split: float) -> Step:
    """`split_us`: when the last part of the series begins."""

    def run(a: Arrays) -> tuple[np.ndarray, ...]:
        n = len(a["us"])
        rank = np.arange(n) / max(1, n - 1)
        late = a["us"][rank >= 1 - split]
        return (np.full(n, late[0] if len(late) else np.inf),)

    return Step(("split_us",), run)
