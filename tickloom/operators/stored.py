"""Stored screeners: conditions kept as rows of a table, all screeners over one pass of the bars.

A condition compares a field with a number, a range, or another field times a factor; a screener
is the conditions of one name, all of which must hold. Only the fields that conditions use are
computed: one fold for the recurrences, one set of windows, and the levels once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from tickloom.operators import indicators as ind
from tickloom.operators import recurrence as rec
from tickloom.operators.series import in_order, keys, numbered, of_series, ratio, rolling, so_far
from tickloom.operators.structure import price_levels

CONDITIONS = "screener string, field string, op string, value double, upper double, other string"
#: Conditions are read by the driver; more than this are refused.
MOST_CONDITIONS = 10_000

_STEPS = {
    **{f"ema{n}": rec.ema(f"ema{n}", "close", n) for n in (8, 20, 21, 50, 200)},
    "rsi": rec.rsi("rsi", 14), "adx": rec.adx(14), "_atr": rec.atr("_atr", 14), "_narrow": rec.atr("_narrow", 10), "macd": rec.macd(12, 26, 9), "supertrend": rec.supertrend(10, 3.0),
}
_NEEDS = {"plus_di": ("adx",), "minus_di": ("adx",), "signal": ("macd",), "macd_up_bars": ("macd",), "macd_down_bars": ("macd",), "atr_percent": ("_atr",), "squeeze": ("ema20", "_narrow")}
#: Fields that the bars bring; a condition on one that they lack fails when the plan is made.
_BARS = ("open", "high", "low", "close", "volume", "value", "frequency")
_LEVELS = ("support_pct", "resistance_pct", "support_strength")


def _since(event: Column) -> Column:
    """Bars since the event last was true, 0 on the bar itself."""
    return F.col("n") - F.last(F.when(event, F.col("n")), ignorenulls=True).over(so_far(in_order()))


def _crossing(a: Column, b: Column) -> tuple[Column, Column]:
    before = lambda x: F.lag(x).over(in_order())
    return (before(a) <= before(b)) & (a > b), (before(a) >= before(b)) & (a < b)


def windowed() -> dict[str, Column]:
    """Fields made of the bars and the recurrences by windows."""
    w, close = in_order(), F.col("close")
    before = F.lag("close").over(w)
    middle, width = ind.sma(20), rolling(F.stddev_pop, close, 20, w)
    golden, death = _crossing(F.col("_sma50"), F.col("_sma200"))
    up, down = _crossing(F.col("macd"), F.col("signal"))
    return {
        "change_pct": 100 * ratio(close - before, before),
        **{f"sma{n}": ind.sma(n) for n in (20, 50, 200)},
        **{f"high_{n}": F.max("high").over(w.rowsBetween(-n, -1)) for n in (20, 50, 250)},
        "relative_volume": ind.relative_volume(),
        "mean_value": rolling(F.avg, F.col("value"), 20, w),
        "atr_percent": 100 * ratio(F.col("_atr"), close),
        # Bollinger bands (20, 2) within Keltner's (20, 1.5 ATR of 10)
        "squeeze": ((middle + 2 * width < F.col("ema20") + 1.5 * F.col("_narrow")) & (middle - 2 * width > F.col("ema20") - 1.5 * F.col("_narrow"))).cast("double"),
        "_golden": golden, "_death": death, "_up": up, "_down": down,
    }


FIELDS = (*_BARS, *_STEPS, "plus_di", "minus_di", "signal", "change_pct", "sma20", "sma50", "sma200", "high_20", "high_50", "high_250", "relative_volume", "mean_value", "atr_percent", "squeeze", "golden_cross_bars", "death_cross_bars", "macd_up_bars", "macd_down_bars", *_LEVELS)


def _nearest_levels(bars: DataFrame) -> DataFrame:
    """Per series, from its last close: the distance in percent to the nearest support and resistance, and the support's strength."""
    met = price_levels(bars).join(ind.tail(bars, 1).select(*keys(), "close"), [*keys()])
    below, above = F.col("level_type") == "support", F.col("level_type") == "resistance"
    near = met.groupBy(*keys(), "close").agg(F.max(F.when(below, F.struct("price", "strength"))).alias("_s"), F.min(F.when(above, F.col("price"))).alias("_r"))
    close = F.col("close")
    return near.select(*keys(), (100 * ratio(close - F.col("_s.price"), close)).alias("support_pct"), (100 * ratio(F.col("_r") - close, close)).alias("resistance_pct"), F.col("_s.strength").alias("support_strength"))


def with_fields(bars: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """bars with the wanted fields. Those of levels are known on the last bar of a series only, null before."""
    strange = sorted(set(wanted) - set(FIELDS))
    if strange:
        raise ValueError(f"unknown fields {strange}")
    steps = {s for f in wanted for s in (f, *_NEEDS.get(f, ())) if s in _STEPS}
    rows = rec.fold(bars, *[_STEPS[s] for s in sorted(steps)]) if steps else bars
    rows = numbered(rows)
    made = windowed()
    rows = rows.withColumns({f: made[f] for f in wanted if f in made})
    events = {"golden_cross_bars": "_golden", "death_cross_bars": "_death", "macd_up_bars": "_up", "macd_down_bars": "_down"}
    if "_golden" in (of := {events[f] for f in wanted if f in events}) or "_death" in of:
        rows = rows.withColumns({"_sma50": ind.sma(50), "_sma200": ind.sma(200)})
    marks = {events[f]: made[events[f]] for f in wanted if f in events}
    rows = rows.withColumns(marks).withColumns({f: _since(F.col(events[f])) for f in wanted if f in events}).drop(*marks, "_sma50", "_sma200")
    if set(_LEVELS) & set(wanted):
        last = F.col("n") == F.count("*").over(of_series())
        rows = rows.withColumn("_last", last).join(_nearest_levels(bars), [*keys()], "left").withColumns({f: F.when(F.col("_last"), F.col(f)) for f in _LEVELS}).drop("_last")
    return rows


def _holds(c: Row) -> Column:
    field = F.col(c["field"]).cast("double")
    if c["op"] == "between":
        return field.between(c["value"], c["upper"])
    right = F.lit(c["value"]) if c["other"] is None else F.col(c["other"]).cast("double") * F.lit(1.0 if c["value"] is None else c["value"])
    ops = {"<": field < right, "<=": field <= right, ">": field > right, ">=": field >= right, "=": field == right}
    if c["op"] not in ops:
        raise ValueError(f"unknown operator {c['op']!r}")
    return ops[c["op"]]


def compiled(conditions: Sequence[Row]) -> dict[str, Column]:
    """Each screener as one condition: all of its rows hold; what is null doesn't."""
    out: dict[str, Column] = {}
    for c in conditions:
        held = F.coalesce(_holds(c), F.lit(False))
        out[c["screener"]] = out[c["screener"]] & held if c["screener"] in out else held
    return out


def run_screeners(bars: DataFrame, conditions: DataFrame, *, last: int | None = 1) -> DataFrame:
    """(key, ts, screener) of the bars that satisfy a stored screener, of each series' `last` bars (None: all).

    conditions: CONDITIONS. op is <, <=, >, >=, = or between (value to upper); with `other` the
    field is compared with that field, times `value` if there is one. Unknown fields or
    operators raise when the plan is made; no conditions, no rows.
    """
    rows = conditions.select("screener", "field", "op", "value", "upper", "other").limit(MOST_CONDITIONS + 1).collect()
    if len(rows) > MOST_CONDITIONS:
        raise ValueError(f"more than {MOST_CONDITIONS} conditions")
    wanted = sorted({f for c in rows for f in (c["field"], c["other"]) if f is not None})
    found = compiled(sorted(rows, key=lambda c: (c["screener"], c["field"])))
    told = _latest(with_fields(bars, wanted), last)
    named = F.array(*[F.when(ok, F.lit(name)) for name, ok in found.items()]).cast("array<string>")
    return told.select(*keys(), "ts", F.explode(F.filter(named, lambda x: x.isNotNull())).alias("screener"))


def _latest(rows: DataFrame, last: int | None) -> DataFrame:
    if last is None:
        return rows
    return rows.withColumn("_bars", F.max("n").over(of_series())).filter(F.col("n") > F.col("_bars") - last).drop("_bars")
