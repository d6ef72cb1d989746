"""Quotes, calendar, fundamentals, screener presets, gates, entry zones, chart patterns and splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.tick import round_to_tick
from tickloom.operators import indicators as ind
from tickloom.operators import recurrence as rec
from tickloom.operators.series import in_order, keys, of_series, ratio, rolling
from tickloom.operators.structure import add_swings

# The exchange's sessions in minutes of the day, Monday to Friday.
SESSIONS = ((9 * 60, 11 * 60 + 30), (13 * 60 + 30, 15 * 60))


def in_session(local: Column) -> Column:
    """Whether a local time lies in a session (start inclusive, end exclusive)."""
    minute = F.hour(local) * 60 + F.minute(local)
    open_ = F.lit(False)
    for start, stop in SESSIONS:
        open_ = open_ | ((minute >= start) & (minute < stop))
    return (F.weekday(local) < 5) & open_


def quotes(bars: DataFrame) -> DataFrame:
    """(symbol, ts, last_price, change, change_pct, volume) of each series' last bar; the percentage is 0 if the price before is 0."""
    rows = bars.withColumn("_prev", F.lag("close").over(in_order()))
    last = ind.tail(rows, 1).withColumn("change", F.col("close") - F.col("_prev"))
    percent = F.when(F.col("_prev") == 0, 0.0).otherwise(100 * ratio(F.col("change"), F.col("_prev")))
    return last.select(*keys(), "ts", F.col("close").alias("last_price"), "change", percent.alias("change_pct"), "volume")


def statement_rows(wide: DataFrame, *, label: str, periods: Sequence[str], labels: Sequence[str]) -> DataFrame:
    """A statement with a row per label and a column per period, turned: one row per period, a column per label, null where missing."""
    long = wide.unpivot(label, list(periods), "period", "amount")
    return long.groupBy("period").pivot(label, list(labels)).agg(F.first("amount", ignorenulls=True))


def year_growth(quarters: DataFrame, amount: str = "revenue") -> DataFrame:
    """Growth over the same quarter a year before, in percent, and its percentile rank within the sector and quarter."""
    rows = quarters.withColumn("growth", 100 * (ratio(F.col(amount), F.lag(amount, 4).over(of_series().orderBy("period"))) - 1))
    peers = Window.partitionBy("sector", "period").orderBy(F.asc_nulls_first("growth"))
    return rows.withColumn("sector_rank", F.percent_rank().over(peers))


def presets() -> dict[str, Column]:
    """Screener presets over bars with prior_high, relvol, rsi, adx, ema20, ema50, ema200 and volume_falling."""
    c = F.col
    return {
        "momentum_breakout": (c("close") > c("prior_high")) & (c("relvol") > 1.2) & c("rsi").between(55, 70) & (c("adx") > 25),
        "pullback": (c("ema50") > c("ema200")) & (c("low") <= c("ema20")) & (c("high") >= c("ema20")) & c("rsi").between(40, 55) & c("volume_falling"),
        "oversold": c("rsi") < 30,
        "high_volume": (c("relvol") > 1.5) & (c("close") > c("open")),
    }


def screen(bars: DataFrame) -> DataFrame:
    """(symbol, ts, preset) of every bar that satisfies a preset."""
    w = in_order()
    rows = rec.fold(bars, *[rec.ema(f"ema{n}", "close", n) for n in (20, 50, 200)], rec.rsi("rsi", 14), rec.adx(14))
    rows = rows.withColumns({"prior_high": F.max("high").over(w.rowsBetween(-20, -1)), "relvol": ind.relative_volume(), "volume_falling": F.coalesce(F.col("volume") < F.lag("volume").over(w), F.lit(False))})
    rows = rows.withColumn("_found", F.filter(F.array(*[F.when(ok, F.lit(name)) for name, ok in presets().items()]), lambda x: x.isNotNull()))
    return rows.select(*keys(), "ts", F.explode("_found").alias("preset"))


def score_presets(scores: DataFrame) -> DataFrame:
    """Rows (trend, momentum, volume, structure, fundamental, change_pct, support_strength) with the presets over factor scores that they satisfy; a missing fundamental score counts as 0."""
    c, fundamental = F.col, F.coalesce(F.col("fundamental"), F.lit(0.0))
    named = {
        "momentum": (c("momentum") > 65) & (c("volume") > 60) & (c("change_pct") > 0),
        "pullback": (c("trend") > 60) & (c("change_pct") < 0),
        "reversal": (c("momentum") < 45) & (c("support_strength") > 60),
        "value": fundamental > 60,
        "dividend": (fundamental > 55) & (c("structure") > 50),
        "volume": c("volume") > 70,
    }
    return scores.withColumn("presets", F.filter(F.array(*[F.when(ok, F.lit(name)) for name, ok in named.items()]), lambda x: x.isNotNull()))


def gated(action: Column, *, rr: Column, least_rr: float, traded: Column, least_traded: float, bars: Column, least_bars: int, suspended: Column) -> Column:
    """The action, but hold where reward to risk, liquidity or history fall short or trading is suspended."""
    ok = (rr >= least_rr) & (traded >= least_traded) & (bars >= least_bars) & ~suspended
    return F.when(F.coalesce(ok, F.lit(False)), action).otherwise("hold")


def mean_value(n: int = 20) -> Column:
    return rolling(F.avg, F.col("value"), n, in_order())


def entry_zone(bars: DataFrame, n: int = 14) -> DataFrame:
    """Per series from its last bar: zone_low the close less an ATR (plain mean of true ranges) rounded down, zone_high 0.4 ATR above rounded up, reference their middle, trigger the tick above zone and high."""
    rows = bars.withColumn("_tr", ind.true_range())
    rows = rows.withColumn("_atr", rolling(F.avg, F.col("_tr"), n, in_order()))
    last = ind.tail(rows, 1)
    to = lambda x, how: round_to_tick(F.round(x, 4), how).cast("double")
    last = last.withColumn("zone_low", to(F.col("close") - F.col("_atr"), "down"))
    last = last.withColumn("zone_high", to(F.col("zone_low") + 0.4 * F.col("_atr"), "up"))
    last = last.withColumn("reference", (F.col("zone_low") + F.col("zone_high")) / 2)
    return last.withColumn("trigger", to(F.greatest("zone_high", "high") + 1, "up")).select(*keys(), "zone_low", "zone_high", "reference", "trigger")


def double_extremes(bars: DataFrame, n: int = 5, tolerance: float = 0.01) -> DataFrame:
    """(symbol, ts, pattern, breakout_level, measured_target): two swings of one kind within `tolerance` of each other with one of the other kind between."""
    rows = add_swings(bars, n)
    highs = rows.filter("swing_high").select(*keys(), "ts", F.col("high").alias("price"), F.lit("high").alias("kind"))
    lows = rows.filter("swing_low").select(*keys(), "ts", F.col("low").alias("price"), F.lit("low").alias("kind"))
    w = of_series().orderBy("ts", "kind")
    seq = highs.unionByName(lows).withColumns({f"{c}{k}": F.lag(c, k).over(w) for k in (1, 2) for c in ("price", "kind")})
    same = (F.col("kind") == F.col("kind2")) & (F.col("kind") != F.col("kind1")) & (F.abs(ratio(F.col("price"), F.col("price2")) - 1) <= tolerance)
    found = seq.filter(same)
    name = F.when(F.col("kind") == "high", "double_top").otherwise("double_bottom")
    return found.select(*keys(), "ts", name.alias("pattern"), F.col("price1").alias("breakout_level"), (2 * F.col("price1") - (F.col("price") + F.col("price2")) / 2).alias("measured_target"))


def holdout(bars: DataFrame, share: float = 0.2) -> DataFrame:
    """bars with `held_out`: whether the bar is in the last part of its series."""
    return bars.withColumn("held_out", F.percent_rank().over(in_order()) >= 1 - share)


def valid_until(generated: Column, mode: str) -> Column:
    """When a signal of that mode expires."""
    ttl = {"scalping": "INTERVAL 15 MINUTES", "day": "INTERVAL 120 MINUTES", "swing": "INTERVAL 7 DAYS", "investing": "INTERVAL 30 DAYS"}[mode]
    return generated + F.expr(ttl)
