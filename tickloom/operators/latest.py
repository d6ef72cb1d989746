"""The fields of a series' last bar that need a window or the whole series, as steps of the fold: no shuffle and no sort of their own."""

from __future__ import annotations

import numpy as np

from tickloom.operators.recurrence import Arrays, Step

# Ratios of the levels between swings and beyond them.
RETRACEMENTS = {"r236": 0.236, "r382": 0.382, "r500": 0.5, "r618": 0.618, "r786": 0.786}
EXTENSIONS = {"e1272": 1.272, "e1618": 1.618, "e2000": 2.0}
#: Sliding windows look at the last bars only.
LOOKBACK = 252
SMA = (5, 10, 20, 50, 100, 200)
PIVOTS = ("pp", "r1", "s1", "r2", "s2", "r3", "s3")
_SLIDING = (
    *(f"sma{n}" for n in SMA), "tenkan", "kijun", "senkou_a", "senkou_b", "chikou", "stoch_k", "stoch_d", "stoch_rsi_k", "stoch_rsi_d", "cci", "williams_r", "roc", "mfi",
    "bb_middle", "bb_upper", "bb_lower", "bb_bandwidth", "bb_percent_b", "dc_upper", "dc_lower", "dc_middle", "hist_vol", "volume_ma", "relative_volume", *PIVOTS,
)


def _windows(x: np.ndarray, n: int) -> np.ndarray:
    """A row per element: it and the n - 1 before it, NaN where there are none."""
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(n - 1, np.nan), x]), n)


def _mean(x: np.ndarray, n: int) -> np.ndarray:
    return _windows(x, n).mean(axis=1)


def _lagged(x: np.ndarray, n: int = 1) -> np.ndarray:
    return np.concatenate([np.full(min(n, len(x)), np.nan), x[: max(0, len(x) - n)]])


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.full(len(a), np.nan), where=b != 0)


def _stochastic(x: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top, bottom = _windows(high, 14).max(axis=1), _windows(low, 14).min(axis=1)
    k = _mean(100 * _ratio(x - bottom, top - bottom), 3)
    return k, _mean(k, 3)


def _sliding(a: Arrays) -> dict[str, np.ndarray]:
    high, low, close, volume, rsi = (a[c][-LOOKBACK:] for c in ("high", "low", "close", "volume", "rsi"))
    made = {f"sma{n}": _mean(close, n) for n in SMA}
    middle = lambda n: (_windows(high, n).max(axis=1) + _windows(low, n).min(axis=1)) / 2
    tenkan, kijun = middle(9), middle(26)
    made |= {"tenkan": tenkan, "kijun": kijun, "senkou_a": _lagged((tenkan + kijun) / 2, 26), "senkou_b": _lagged(middle(52), 26), "chikou": np.concatenate([close[26:], np.full(min(26, len(close)), np.nan)])}
    made["stoch_k"], made["stoch_d"] = _stochastic(close, high, low)
    made["stoch_rsi_k"], made["stoch_rsi_d"] = _stochastic(rsi, rsi, rsi)
    price = (high + low + close) / 3
    around = _windows(price, 20)
    mean = around.mean(axis=1)
    made["cci"] = _ratio(price - mean, 0.015 * np.abs(around - mean[:, None]).mean(axis=1))
    top, bottom = _windows(high, 14).max(axis=1), _windows(low, 14).min(axis=1)
    made["williams_r"] = -100 * _ratio(top - close, top - bottom)
    made["roc"] = 100 * _ratio(close - _lagged(close, 12), _lagged(close, 12))
    step = price - _lagged(price)
    gain, loss = (_windows(np.where(side, price * volume, 0.0), 14).sum(axis=1) for side in (step > 0, step < 0))
    made["mfi"] = np.where(loss == 0, 100.0, 100 - 100 / (1 + _ratio(gain, loss)))
    wide = 2 * _windows(close, 20).std(axis=1)
    upper, lower = made["sma20"] + wide, made["sma20"] - wide
    made |= {"bb_middle": made["sma20"], "bb_upper": upper, "bb_lower": lower, "bb_bandwidth": 100 * _ratio(upper - lower, made["sma20"]), "bb_percent_b": _ratio(close - lower, upper - lower)}
    made |= {"dc_upper": _windows(high, 20).max(axis=1), "dc_lower": _windows(low, 20).min(axis=1)}
    made["dc_middle"] = (made["dc_upper"] + made["dc_lower"]) / 2
    change = _ratio(close, _lagged(close))
    made["hist_vol"] = _windows(np.log(np.where(change > 0, change, np.nan)), 20).std(axis=1) * np.sqrt(252) * 100
    made["volume_ma"] = _mean(volume, 20)
    made["relative_volume"] = _ratio(volume, made["volume_ma"])
    h, l, c = _lagged(high), _lagged(low), _lagged(close)
    pp = (h + l + c) / 3
    made |= {"pp": pp, "r1": 2 * pp - l, "s1": 2 * pp - h, "r2": pp + (h - l), "s2": pp - (h - l), "r3": h + 2 * (pp - l), "s3": l - 2 * (h - pp)}
    return made


def sliding() -> Step:
    """What looks back over windows, as of the operators of the same names; known on the last LOOKBACK bars. Needs `rsi`."""

    def run(a: Arrays) -> tuple[np.ndarray, ...]:
        with np.errstate(invalid="ignore", divide="ignore"):
            made = _sliding(a)
        before = np.full(max(0, len(a["close"]) - LOOKBACK), np.nan)
        return tuple(np.concatenate([before, made[c]]) for c in _SLIDING)

    return Step(_SLIDING, run)


def running() -> Step:
    """`obv` and `accum_dist`, sums from the first bar on, and `vwap` of the last bar's day (`_day`) on that day's bars."""

    def run(a: Arrays) -> tuple[np.ndarray, ...]:
        high, low, close, volume = (a[c] for c in ("high", "low", "close", "volume"))
        with np.errstate(invalid="ignore", divide="ignore"):
            way = np.sign(close - _lagged(close))
            flow = np.where(np.isnan(way), 0.0, way) * volume
            spread = np.where(high == low, 0.0, _ratio((close - low) - (high - close), high - low)) * volume
            today = a["_day"] == a["_day"][-1] if len(close) else np.zeros(0, bool)
            money = np.nancumsum(np.where(today, (high + low + close) / 3 * volume, 0.0))
            vwap = np.where(today, _ratio(money, np.nancumsum(np.where(today, volume, 0.0))), np.nan)
        return np.nancumsum(flow), np.nancumsum(spread), vwap

    return Step(("obv", "accum_dist", "vwap"), run)


def profile(buckets: int = 50, last: int = 250, share: float = 0.7, least: int = 10) -> Step:
    """`poc`, `vah`, `val` of the last bars as value_area() has them, on every bar; NaN if the series has fewer than `least`."""

    def run(a: Arrays) -> tuple[np.ndarray, ...]:
        n = len(a["close"])
        high, low, close, volume = (a[c][-last:] for c in ("high", "low", "close", "volume"))
        price = (high + low + close) / 3
        known = ~np.isnan(price)
        if n < least or not known.any():
            return (np.full(n, np.nan),) * 3
        lo, hi = np.nanmin(low), np.nanmax(high)
        at = np.ones(len(price), int) if lo == hi else np.where(known, np.minimum(np.floor(buckets * (np.where(known, price, lo) - lo) / (hi - lo)) + 1, buckets), 0).astype(int)
        names = np.unique(at[known])
        summed = np.array([np.nansum(volume[known & (at == b)]) for b in names])
        order = np.lexsort((names, -summed))
        before = np.cumsum(summed[order]) - summed[order]
        kept = order[(before < share * summed.sum()) | (np.arange(len(order)) == 0)]
        width = (hi - lo) / buckets
        top = names[order[0]]
        poc = (lo + (top - 1) * width + lo + top * width) / 2
        return tuple(np.full(n, x) for x in (poc, lo + names[kept].max() * width, lo + (names[kept].min() - 1) * width))

    return Step(("poc", "vah", "val"), run)


def only_extreme(x: np.ndarray, n: int, highest: bool) -> np.ndarray:
    """Where the value is the only extreme of itself and n rows on each side, all there."""
    out = np.zeros(len(x), bool)
    if len(x) > 2 * n:
        around = np.lib.stride_tricks.sliding_window_view(x, 2 * n + 1)
        sides = np.delete(around, n, axis=1)
        out[n : len(x) - n] = (around[:, n] > sides.max(axis=1) if highest else around[:, n] < sides.min(axis=1)) & ~np.isnan(around).any(axis=1)
    return out


def fibonacci(n: int = 5) -> Step:
    """The levels between the last swing low and the last swing high as fibonacci_levels() has them, on every bar; NaN unless the high is above the low."""
    names = (*RETRACEMENTS, *EXTENSIONS)

    def run(a: Arrays) -> tuple[np.ndarray, ...]:
        tops, bottoms = np.flatnonzero(only_extreme(a["high"], n, True)), np.flatnonzero(only_extreme(a["low"], n, False))
        high, low = a["high"][tops[-1]] if len(tops) else np.nan, a["low"][bottoms[-1]] if len(bottoms) else np.nan
        there = high > low
        levels = [high - r * (high - low) for r in RETRACEMENTS.values()] + [low + r * (high - low) for r in EXTENSIONS.values()]
        return tuple(np.full(len(a["high"]), x if there else np.nan) for x in levels)

    return Step(names, run)
