"""Validation, search, ranking, screening, trade plans and portfolio arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tickloom.functions.tick import round_to_tick
from tickloom.operators import indicators as ind
from tickloom.operators import recurrence as rec
from tickloom.operators.series import at_micros, in_order, keys, micros, of_series, ratio, so_far

OHLC = ("open", "high", "low", "close")

# Bars that each mode needs, and its parameters.
LEAST_BARS = {"scalping": 300, "day": 100, "swing": 200, "investing": 200}
MODES = {
    "scalping": dict(trend=0.15, momentum=0.30, volume=0.30, volatility=0.15, structure=0.10, fundamental=0.0, k_atr=1.0, max_risk=0.008, risk=0.005, max_position=0.15, tp=(1.0, 1.5, 2.0), min_rr=1.2),
    "day": dict(trend=0.25, momentum=0.25, volume=0.25, volatility=0.10, structure=0.15, fundamental=0.0, k_atr=1.5, max_risk=0.02, risk=0.01, max_position=0.25, tp=(1.0, 2.0, 3.0), min_rr=1.5),
    "swing": dict(trend=0.30, momentum=0.20, volume=0.15, volatility=0.10, structure=0.25, fundamental=0.0, k_atr=2.0, max_risk=0.07, risk=0.015, max_position=0.30, tp=(1.5, 2.5, 4.0), min_rr=2.0),
    "investing": dict(trend=0.20, momentum=0.10, volume=0.05, volatility=0.05, structure=0.15, fundamental=0.45, k_atr=3.0, max_risk=0.15, risk=0.02, max_position=0.40, tp=(2.0, 4.0, 6.0), min_rr=2.5),
}
FACTORS = ("trend", "momentum", "volume", "volatility", "structure", "fundamental")


# --- validation ---


def drop_suspended(bars: DataFrame) -> DataFrame:
    """Without bars of zero volume; an unknown volume stays."""
    return bars.filter(~F.coalesce(F.col("volume") == 0, F.lit(False)))


def corporate_actions(bars: DataFrame, jump: float = 0.35) -> DataFrame:
    """(symbol, ts, change) of closes that move by more than `jump` from the one before."""
    change = ratio(F.col("close"), F.lag("close").over(in_order())) - 1
    return drop_suspended(bars).withColumn("change", change).filter(F.abs("change") > jump).select(*keys(), "ts", "change")


def add_gap_runs(bars: DataFrame) -> DataFrame:
    """bars with `gap` (any price missing), `run`, the number of gaps in a row up to the bar, and `island`, which tells runs apart."""
    gap = F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull()
    rows = bars.withColumn("gap", gap).withColumn("island", F.sum((~gap).cast("int")).over(so_far(in_order())))
    run = F.sum(F.col("gap").cast("int")).over(so_far(of_series("island").orderBy("ts")))
    return rows.withColumn("run", run)


def fill_gaps(bars: DataFrame, most: int = 2) -> DataFrame:
    """Prices carried forward over at most `most` bars; `filled` marks bars that had a gap."""
    frame = in_order().rowsBetween(-most, 0)
    rows = bars.withColumn("filled", F.col("open").isNull() | F.col("high").isNull() | F.col("low").isNull() | F.col("close").isNull())
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(frame) for c in OHLC})


def validation_report(bars: DataFrame, mode: str, most_gap: int = 2) -> DataFrame:
    """One row per series: bars, suspended, flags, filled, longest_gap, gap_start and status (ok, gap or short)."""
    if mode not in LEAST_BARS:
        raise ValueError(f"unknown mode {mode!r}")
    suspended = F.coalesce(F.col("volume") == 0, F.lit(False))
    total = bars.groupBy(*keys()).agg(F.count(F.when(suspended, 1)).alias("suspended"))
    rows = add_gap_runs(drop_suspended(bars)).withColumn("_jump", F.abs(ratio(F.col("close"), F.lag("close").over(in_order())) - 1) > 0.35)
    rows = rows.withColumn("_start", F.when(F.col("gap"), F.min(F.when(F.col("gap"), F.col("ts"))).over(of_series("island"))))
    kept = rows.groupBy(*keys()).agg(
        F.count("*").alias("bars"), F.count(F.when(F.col("_jump"), 1)).alias("flags"), F.count(F.when(F.col("gap"), 1)).alias("filled"), F.coalesce(F.max("run"), F.lit(0)).alias("longest_gap"),
        F.min_by("_start", F.struct(-F.col("run"), "ts")).alias("gap_start"),
    )
    status = F.when(F.col("longest_gap") > most_gap, "gap").when(F.col("bars") < LEAST_BARS[mode], "short").otherwise("ok")
    return total.join(kept, [*keys()], "left").na.fill(0, ["bars", "flags", "filled", "longest_gap"]).withColumn("status", status)


def validated(bars: DataFrame, mode: str, most_gap: int = 2) -> DataFrame:
    """The clean bars of the series that pass: no suspended bars, gaps of up to `most_gap` filled; series with a longer gap or too few bars are left out (see validation_report)."""
    fine = validation_report(bars, mode, most_gap).filter("status = 'ok'").select(*keys())
    return fill_gaps(drop_suspended(bars), most_gap).join(fine, [*keys()], "left_semi")


class NotFound(LookupError):
    """No instrument, or several, where one is asked for."""


class InsufficientData(ValueError):
    """A series with fewer bars than are needed."""


def one_instrument(instruments: DataFrame, symbol: str, *, exchange: str | None = None) -> Row:
    """The instrument of that symbol (any case); raises NotFound if there is none, or several on different exchanges."""
    found = instruments.filter(F.col("symbol") == symbol.upper())
    rows = (found if exchange is None else found.filter(F.col("exchange") == exchange)).limit(2).collect()
    if len(rows) != 1:
        raise NotFound(f"{len(rows) or 'no'} instruments {symbol.upper()!r}")
    return rows[0]


def require_bars(bars: DataFrame, least: int = 60) -> DataFrame:
    """bars, if there are so many; else raises InsufficientData."""
    there = bars.limit(least).count()
    if there < least:
        raise InsufficientData(f"{there} bars, {least} needed")
    return bars


def sufficiency(bars: DataFrame, least: int = 60) -> DataFrame:
    """(symbol, available_bars, enough) of every series."""
    return bars.groupBy(*keys()).agg(F.count("*").alias("available_bars")).withColumn("enough", F.col("available_bars") >= least)


# --- search, summary, ranking ---


def search(instruments: DataFrame, text: str | None = None, *, sector: str | None = None, exchange: str | None = None) -> DataFrame:
    """Instruments whose symbol or name matches %text% (any case; % and _ are wildcards), of a sector and an exchange."""
    out = instruments
    if text:
        out = out.filter(F.col("symbol").ilike(f"%{text}%") | F.col("name").ilike(f"%{text}%")) if "name" in out.columns else out.filter(F.col("symbol").ilike(f"%{text}%"))
    out = out if sector is None else out.filter(F.col("sector") == sector)
    return out if exchange is None else out.filter(F.col("exchange") == exchange)


def between(bars: DataFrame, start: str | None = None, stop: str | None = None) -> DataFrame:
    """start <= ts <= stop, each optional."""
    if start is not None:
        bars = bars.filter(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    return bars if stop is None else bars.filter(F.col("ts") <= F.lit(stop).cast("timestamp_ntz"))


def summary(instruments: DataFrame, bars: DataFrame) -> DataFrame:
    """Every instrument with its last and previous close and the change in percent (null without a previous one, or if that is 0)."""
    latest = of_series().orderBy(F.desc("ts"))
    last = bars.select(*keys(), "ts", "close").withColumn("_r", F.row_number().over(latest)).filter("_r <= 2")
    ends = last.groupBy(*keys()).agg(F.max(F.when(F.col("_r") == 1, F.col("close"))).alias("last_price"), F.max(F.when(F.col("_r") == 2, F.col("close"))).alias("prev_price"))
    met = instruments.join(ends, [*keys()], "left")
    return met.withColumn("change_pct", 100 * ratio(F.col("last_price") - F.col("prev_price"), F.col("prev_price")))


def movers(summed: DataFrame, n: int = 5, gainers: bool = True) -> DataFrame:
    """The n largest gains or losses; ties by symbol."""
    known = summed.filter("change_pct IS NOT NULL AND last_price IS NOT NULL")
    return known.orderBy(F.desc("change_pct") if gainers else F.asc("change_pct"), *keys()).limit(n)


def sparkline(bars: DataFrame, n: int = 20) -> DataFrame:
    """(symbol, line): the last n closes, scaled to 0..1 (all equal: 0.5), as one array."""
    rows = ind.tail(bars, n).groupBy(*keys()).agg(F.transform(F.sort_array(F.collect_list(F.struct("ts", "close"))), lambda x: x["close"]).alias("line"))
    lo, hi = F.array_min("line"), F.array_max("line")
    return rows.select(*keys(), F.transform("line", lambda x: F.when(lo == hi, 0.5).otherwise(F.try_divide(x - lo, hi - lo))).alias("line"))


# --- scores and plans ---


def trend_score(bars: DataFrame) -> DataFrame:
    """(symbol, ts, trend_score): 20 points each for close over EMA20, EMA20 over EMA50, EMA50 over EMA200, ADX over 25 (10 over 20) and a rising SuperTrend."""
    rows = rec.fold(bars, *[rec.ema(f"ema{n}", "close", n) for n in (20, 50, 200)], rec.adx(14), rec.supertrend(10, 3.0))
    points = lambda ok, n: F.when(ok, n).otherwise(0)
    score = points(F.col("close") > F.col("ema20"), 20) + points(F.col("ema20") > F.col("ema50"), 20) + points(F.col("ema50") > F.col("ema200"), 20)
    score = score + F.when(F.col("adx") > 25, 20).when(F.col("adx") > 20, 10).otherwise(0) + points(F.col("direction") == "up", 20)
    return rows.select(*keys(), "ts", score.cast("int").alias("trend_score"))


def composite(scores: dict[str, Column], mode: str) -> Column:
    """Weighted mean of the factor scores; a missing one counts as 0."""
    weights = {f: MODES[mode][f] for f in FACTORS}
    total = sum(weights.values())
    out = F.lit(0.0)
    for f, w in weights.items():
        out = out + F.coalesce(scores.get(f, F.lit(None)).cast("double"), F.lit(0.0)) * (w / total)
    return out


def action(score: Column) -> Column:
    return F.when(score >= 80, "strong_buy").when(score >= 65, "buy").when(score >= 45, "hold").when(score >= 30, "reduce").otherwise("sell")


def confidence(score: Column) -> Column:
    return F.when((score >= 80) | (score < 30), "high").otherwise("medium")


def trade_plan(bars: DataFrame, mode: str, capital: float = 100e6, lot: int = 100) -> DataFrame:
    """Per series, from its last bar: entry, stop, targets, reward to risk, lots.

    Entry is the close on its tick; the stop the highest of the last swing low (20 bars) less half an ATR, entry less
    k ATR, and entry less the largest risk, rounded down; targets are multiples of the risk,
    rounded down; lots keep risk and exposure within the mode's limits.
    """
    m = MODES[mode]
    rows = ind.add_atr(bars).withColumn("swing_low", F.min("low").over(in_order().rowsBetween(-19, 0)))
    last = ind.tail(rows, 1).select(*keys(), "ts", "close", "atr", "swing_low")
    last = last.withColumn("entry", round_to_tick(F.round("close", 4), "nearest").cast("double"))
    stop = F.greatest(F.col("swing_low") - 0.5 * F.col("atr"), F.col("entry") - m["k_atr"] * F.col("atr"), F.col("entry") * (1 - m["max_risk"]))
    last = last.withColumn("stop", round_to_tick(F.round(stop, 4), "down").cast("double")).withColumn("risk", F.col("entry") - F.col("stop"))
    for i, r in enumerate(m["tp"], 1):
        last = last.withColumn(f"tp{i}", round_to_tick(F.round(F.col("entry") + r * F.col("risk"), 4), "down").cast("double"))
    last = last.withColumn("rr", F.round(ratio(F.col("tp2") - F.col("entry"), F.col("risk")), 2))
    by_risk = F.when(F.col("risk") > 0, F.try_divide(F.lit(capital * m["risk"]), F.col("risk") * lot))
    by_exposure = ratio(F.lit(capital * m["max_position"]), F.col("entry") * lot)
    return last.withColumn("lots", F.greatest(F.lit(0), F.floor(F.least(by_risk, by_exposure))).cast("bigint")).drop("swing_low")


def breakout(bars: DataFrame, n: int = 20, relative: float = 1.2, rsi: tuple[float, float] = (50.0, 75.0)) -> DataFrame:
    """Bars that close above the highest high of the n before on more than `relative` of the usual volume, RSI in range."""
    rows = ind.add_rsi(bars).withColumns({"prior_high": F.max("high").over(in_order().rowsBetween(-n, -1)), "relvol": ind.relative_volume()})
    return rows.filter((F.col("close") > F.col("prior_high")) & (F.col("relvol") > relative) & F.col("rsi").between(*rsi)).select(*keys(), "ts", "close", "prior_high", "relvol", "rsi")


def crosses(bars: DataFrame, fast: int = 20, slow: int = 50, within: int = 5) -> DataFrame:
    """Bars with whether a golden or death cross of the simple means happened within the last bars."""
    rows = bars.withColumns({"_f": ind.sma(fast), "_s": ind.sma(slow)})
    rows = rows.withColumns({"_pf": F.lag("_f").over(in_order()), "_ps": F.lag("_s").over(in_order())})
    rows = rows.withColumns({"_g": (F.col("_pf") <= F.col("_ps")) & (F.col("_f") > F.col("_s")), "_d": (F.col("_pf") >= F.col("_ps")) & (F.col("_f") < F.col("_s"))})
    frame = in_order().rowsBetween(1 - within, 0)
    seen = lambda c: F.coalesce(F.max(F.coalesce(F.col(c), F.lit(False))).over(frame), F.lit(False))
    return rows.withColumns({"golden_cross": seen("_g"), "death_cross": seen("_d")}).drop("_f", "_s", "_pf", "_ps", "_g", "_d")


def portfolio(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Each position (symbol, side, qty, avg_entry) with market value, cost, unrealised profit, its percentage and the share of the whole."""
    rows = positions.join(prices, [*keys()])
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    rows = rows.withColumns({"market_value": F.col("qty") * F.col("price"), "cost": F.col("qty") * F.col("avg_entry")})
    rows = rows.withColumn("pnl", sign * (F.col("market_value") - F.col("cost")))
    total = rows.agg(F.sum("market_value").alias("total_value"), F.sum("cost").alias("total_cost"), F.sum("pnl").alias("total_pnl"))
    rows = rows.crossJoin(F.broadcast(total))  # one row
    percent = lambda a, b: F.coalesce(100 * ratio(F.col(a), F.col(b)), F.lit(0.0))
    return rows.withColumns({"pnl_pct": percent("pnl", "cost"), "allocation_pct": percent("market_value", "total_value"), "total_pnl_pct": percent("total_pnl", "total_cost")})


def signals(scored: DataFrame, *, text: str | None = None, actions: Sequence[str] = (), least: float | None = None, limit: int | None = None) -> DataFrame:
    """Scored rows (key, ts, score, action) whose symbol or, if there is one, name holds the text (any case), whose action is listed (none: any) and whose score is at least so high; best first, ties by series and time."""
    out = scored
    if text:
        holds = [F.contains(F.lower(c), F.lit(text.lower())) for c in ("symbol", "name") if c in scored.columns]
        out = scored.filter(holds[0] | F.coalesce(holds[1], F.lit(False)) if len(holds) > 1 else holds[0])
    out = out if not actions else out.filter(F.col("action").isin(list(actions)))
    out = out if least is None else out.filter(F.col("score") >= least)
    out = out.orderBy(F.desc("score"), *keys(), "ts")
    return out if limit is None else out.limit(limit)


def journal(closed: DataFrame) -> DataFrame:
    """Per series, of closed positions (key, side, qty, avg_entry, stop, exit): trades, win_rate in percent, mean and sum of the profit, and the mean multiple of the risk taken (null where the stop is the entry)."""
    sign = F.when(F.col("side") == "long", 1).otherwise(-1)
    gain = sign * (F.col("exit") - F.col("avg_entry"))
    rows = closed.withColumns({"_pnl": gain * F.col("qty"), "_r": ratio(gain, F.abs(F.col("avg_entry") - F.col("stop")))})
    return rows.groupBy(*keys()).agg(
        F.count("*").alias("trades"), (100 * F.avg((F.col("_pnl") > 0).cast("double"))).alias("win_rate"), F.avg("_pnl").alias("mean_pnl"), F.sum("_pnl").alias("total_pnl"), F.avg("_r").alias("mean_r")
    )


#: Shares of a position sold at each target; after the first the stop moves to the entry.
SCALE_OUT = (0.4, 0.3, 0.3)


def scale_out(plan: DataFrame, shares: Sequence[float] = SCALE_OUT) -> DataFrame:
    """A plan's lots by target: (symbol, step, target, lots, stop_after), whole lots, the last step taking what is left."""
    first, second = F.floor(F.col("lots") * shares[0]), F.floor(F.col("lots") * shares[1])
    steps = [(1, "tp1", first, F.col("entry")), (2, "tp2", second, F.col("entry")), (3, "tp3", F.col("lots") - first - second, F.lit(None).cast("double"))]
    made = F.array(*[F.struct(F.lit(i).alias("step"), F.col(t).alias("target"), n.cast("bigint").alias("lots"), s.alias("stop_after")) for i, t, n, s in steps])
    return plan.select(*keys(), F.explode(made).alias("x")).select(*keys(), "x.*")


# --- backtest ---


def _trades(fast: str, k_atr: float, target: float, entry_fee: float, exit_fee: float, slip: float) -> rec.Step:
    """The trades of a series, each on the bar that ends it: `entered` (microseconds), `bought`, `sold`, `return`, `r`."""

    def run(a: rec.Arrays) -> tuple[np.ndarray, ...]:
        close, mean = a["close"], a[fast]
        out = np.full((5, len(close)), np.nan)
        signal = np.zeros(len(close), bool)
        signal[1:] = (close[1:] > mean[1:]) & (close[:-1] <= mean[:-1])
        stops, takes = close - k_atr * a["atr"], close + target * k_atr * a["atr"]
        o, h, l, stop, take, us = (x.tolist() for x in (a["open"], a["high"], a["low"], stops, takes, a["us"]))
        bought = None
        for i in range(1, len(o)):
            if bought is None:
                if signal[i - 1] and o[i] > stop[i - 1]:
                    bought = (i, o[i] * (1 + slip), stop[i - 1], take[i - 1])
                else:
                    continue
            at, price, s, t = bought
            exit_at = min(o[i], s) if l[i] <= s else (max(o[i], t) if h[i] >= t else None) if i > at or h[i] >= t else None
            if exit_at is not None:
                got, paid = exit_at * (1 - slip), price * (1 + entry_fee)
                out[:, i] = us[at], price, got, (got * (1 - exit_fee) - paid) / paid, (got - price) / (price - s)
                bought = None
        return tuple(out)

    return rec.Step(("entered", "bought", "sold", "return", "r"), run)


def backtest(bars: DataFrame, *, fast: int = 20, k_atr: float = 2.0, target: float = 2.5, entry_fee: float = 0.0015, exit_fee: float = 0.0025, slip: float = 0.001) -> DataFrame:
    """(key, entry_ts, exit_ts, entry, exit, return, r): long when the close crosses its EMA upwards, from the next open on, to stop or target.

    A bar decides on itself and those before only; a gap through the stop fills at the open, a
    bar that touches both fills the stop. All of it is one fold.
    """
    rows = bars.select(*keys(), "ts", *OHLC, micros().alias("us"))
    told = rec.fold(rows, rec.ema("fast", "close", fast), rec.atr("atr", 14), _trades("fast", k_atr, target, entry_fee, exit_fee, slip)).filter("entered IS NOT NULL")
    entered = at_micros("entered", bars.schema["ts"].dataType)
    return told.select(*keys(), entered.alias("entry_ts"), F.col("ts").alias("exit_ts"), F.col("bought").alias("entry"), F.col("sold").alias("exit"), "return", "r")


def backtest_metrics(trades: DataFrame) -> DataFrame:
    """Per series: trades, win rate, profit factor, expectancy in R, total return, yearly return, largest drawdown and
    the yearly return over it, Sharpe and Sortino ratios per trade, and the longest losing streak."""
    by_time = of_series().orderBy("entry_ts")
    order, won = so_far(by_time), F.col("return") > 0
    rows = trades.withColumn("_equity", F.exp(F.sum(F.ln(1 + F.col("return"))).over(order)))
    rows = rows.withColumns({"_down": F.col("_equity") / F.greatest(F.lit(1.0), F.max("_equity").over(order)) - 1, "_island": F.sum(won.cast("int")).over(order)})
    rows = rows.withColumn("_streak", F.sum((~won).cast("int")).over(so_far(of_series("_island").orderBy("entry_ts"))))
    gain, loss = F.sum(F.when(won, F.col("return"))), -F.sum(F.when(F.col("return") < 0, F.col("return")))
    years = (F.unix_micros(F.max("exit_ts").cast("timestamp")) - F.unix_micros(F.min("entry_ts").cast("timestamp"))) / (365.25 * 86_400e6)
    growth = F.exp(F.sum(F.ln(1 + F.col("return"))))
    below = F.sqrt(F.avg(F.pow(F.least(F.col("return"), F.lit(0.0)), 2)))
    told = rows.groupBy(*keys()).agg(
        F.count("*").alias("trades"),
        (100 * F.avg(won.cast("double"))).alias("win_rate"),
        F.try_divide(gain, loss).alias("profit_factor"),
        F.avg("r").alias("expectancy_r"),
        (growth - 1).alias("total_return"),
        F.when(years > 0, F.pow(growth, F.try_divide(F.lit(1.0), years)) - 1).alias("cagr"),
        F.min("_down").alias("max_drawdown"),
        F.try_divide(F.avg("return"), F.stddev_pop("return")).alias("sharpe"),
        F.try_divide(F.avg("return"), below).alias("sortino"),
        F.max("_streak").alias("longest_losing_streak"),
    )
    return told.withColumn("calmar", F.try_divide(F.col("cagr"), F.abs("max_drawdown")))
