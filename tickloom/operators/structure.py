"""Pivot points, Fibonacci levels, swings, support and resistance levels, and candlestick patterns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.indicators import fractal
from tickloom.operators.latest import EXTENSIONS, RETRACEMENTS
from tickloom.operators.levels import every_level
from tickloom.operators.series import in_order, keys, numbered, of_series

def pivots(high: Column, low: Column, close: Column, method: str = "classic") -> dict[str, Column]:
    """The pivot and its resistances and supports from one bar."""
    pp, span = (high + low + close) / 3, high - low
    if method == "classic":
        return {"pp": pp, "r1": 2 * pp - low, "s1": 2 * pp - high, "r2": pp + span, "s2": pp - span, "r3": high + 2 * (pp - low), "s3": low - 2 * (high - pp)}
    if method == "fibonacci":
        out = {"pp": pp}
        for i, r in ((1, 0.382), (2, 0.618), (3, 1.0)):
            out |= {f"r{i}": pp + r * span, f"s{i}": pp - r * span}
        return out
    if method == "camarilla":
        out = {"pp": pp}
        for i, d in ((1, 12), (2, 6), (3, 4), (4, 2)):
            out |= {f"r{i}": close + span * 1.1 / d, f"s{i}": close - span * 1.1 / d}
        return out
    raise ValueError(f"unknown pivot method {method!r}")


def daily_pivots(bars: DataFrame, method: str = "classic") -> DataFrame:
    """Each bar with the pivots of the bar before it."""
    rows = bars.withColumns({f"_{c}": F.lag(c).over(in_order()) for c in ("high", "low", "close")})
    named = pivots(F.col("_high"), F.col("_low"), F.col("_close"), method)
    return rows.withColumns(named).drop("_high", "_low", "_close")


def retracements(low: Column, high: Column) -> dict[str, Column]:
    return {k: high - r * (high - low) for k, r in RETRACEMENTS.items()}


def extensions(low: Column, high: Column) -> dict[str, Column]:
    return {k: low + r * (high - low) for k, r in EXTENSIONS.items()}


def add_swings(bars: DataFrame, n: int = 5) -> DataFrame:
    return bars.withColumns({"swing_high": fractal(F.col("high"), n, True), "swing_low": fractal(F.col("low"), n, False)})


def fibonacci_levels(bars: DataFrame, n: int = 5) -> DataFrame:
    """Per series the levels between its last swing low and last swing high, where the high is above the low."""
    rows = add_swings(bars, n)
    last = rows.groupBy(*keys()).agg(
        F.max_by("low", F.when(F.col("swing_low"), F.col("ts"))).alias("swing_low"), F.max_by("high", F.when(F.col("swing_high"), F.col("ts"))).alias("swing_high")
    )
    last = last.filter(F.col("swing_high") > F.col("swing_low"))
    return last.select(*keys(), "swing_low", "swing_high", *[c.alias(k) for k, c in (retracements(F.col("swing_low"), F.col("swing_high")) | extensions(F.col("swing_low"), F.col("swing_high"))).items()])


# --- levels ---


def swing_clusters(bars: DataFrame, timeframe: str = "1w", last: int = 250) -> DataFrame:
    """Swings of the last bars, chained into clusters where neighbours in price lie within half an ATR: one row per cluster, with its strength."""
    return every_level(bars, timeframe, last).filter("source = 'swing'").drop("source", "close", "role_flipped")


def supplementary_levels(bars: DataFrame) -> DataFrame:
    """(key, source, price, strength, first_seen, last_tested): point of control, pivots of the bar and week before, round numbers, long means, 52-week extremes. Both times are those of the last bar."""
    return every_level(bars).filter("source <> 'swing'").select(*keys(), "source", "price", "strength", "first_seen", "last_tested")


def price_levels(bars: DataFrame, timeframe: str = "1w", each: int = 8, least: float = 40.0) -> DataFrame:
    """The strongest `each` supports and resistances of each series, with whether the side was changed within 20 bars."""
    rows = every_level(bars, timeframe).filter(F.col("strength") >= least)
    rows = rows.withColumn("level_type", F.when(F.col("price") < F.col("close"), "support").otherwise("resistance"))
    order = of_series("level_type").orderBy(F.desc("strength"), "price", "source")
    return rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= each).select(*keys(), "level_type", "price", "strength", "source", "touches", "role_flipped", "first_seen", "last_tested")


# --- candlestick patterns ---

# Reliability of each pattern.
RELIABILITY = {
    "doji": 40, "marubozu": 65, "hammer": 60, "hanging_man": 55, "inverted_hammer": 55, "shooting_star": 60, "bullish_engulfing": 70, "bearish_engulfing": 70,
    "piercing_line": 65, "dark_cloud_cover": 65, "morning_star": 78, "evening_star": 78, "three_white_soldiers": 75, "three_black_crows": 75,
}


def _bar(back: int) -> dict[str, Column]:
    o, h, l, c = (F.lag(x, back).over(in_order()) if back else F.col(x) for x in ("open", "high", "low", "close"))
    body = F.abs(c - o)
    return {"o": o, "h": h, "l": l, "c": c, "body": body, "span": h - l, "upper": h - F.greatest(o, c), "lower": F.least(o, c) - l, "green": c > o, "red": c < o, "top": F.greatest(o, c), "bottom": F.least(o, c)}


def shapes() -> dict[str, tuple[str, Column, int]]:
    """name: (context it needs, condition on the bars, number of bars before the last)."""
    a, b, c = _bar(0), _bar(1), _bar(2)
    doji = (a["span"] > 0) & (a["body"] <= 0.1 * a["span"])
    hammer = (a["body"] != 0) & (a["lower"] >= 2 * a["body"]) & (a["upper"] <= 0.3 * a["body"])
    inverted = (a["body"] != 0) & (a["upper"] >= 2 * a["body"]) & (a["lower"] <= 0.3 * a["body"])
    middle_b, middle_c = (b["o"] + b["c"]) / 2, (c["o"] + c["c"]) / 2
    steps = lambda way: (c[way] & b[way] & a[way])
    inside = lambda x, y: (x["o"] > y["bottom"]) & (x["o"] < y["top"])
    return {
        "doji": ("any", doji, 0),
        "marubozu": ("any", (a["span"] > 0) & ~doji & (a["body"] >= 0.95 * a["span"]), 0),
        "hammer": ("bullish", hammer, 0),
        "hanging_man": ("bearish", hammer, 0),
        "inverted_hammer": ("bullish", inverted, 0),
        "shooting_star": ("bearish", inverted, 0),
        "bullish_engulfing": ("bullish", b["red"] & a["green"] & (a["o"] <= b["c"]) & (a["c"] >= b["o"]) & (a["body"] > b["body"]), 1),
        "bearish_engulfing": ("bearish", b["green"] & a["red"] & (a["o"] >= b["c"]) & (a["c"] <= b["o"]) & (a["body"] > b["body"]), 1),
        "piercing_line": ("bullish", b["red"] & a["green"] & (a["o"] < b["l"]) & (a["c"] > middle_b) & (a["c"] < b["o"]), 1),
        "dark_cloud_cover": ("bearish", b["green"] & a["red"] & (a["o"] > b["h"]) & (a["c"] < middle_b) & (a["c"] > b["o"]), 1),
        "morning_star": ("bullish", c["red"] & (b["body"] <= 0.5 * c["body"]) & a["green"] & (a["c"] > middle_c), 2),
        "evening_star": ("bearish", c["green"] & (b["body"] <= 0.5 * c["body"]) & a["red"] & (a["c"] < middle_c), 2),
        "three_white_soldiers": ("bullish", steps("green") & (b["c"] > c["c"]) & (a["c"] > b["c"]) & inside(b, c) & inside(a, b), 2),
        "three_black_crows": ("bearish", steps("red") & (b["c"] < c["c"]) & (a["c"] < b["c"]) & inside(b, c) & inside(a, b), 2),
    }


def candle_shapes(bars: DataFrame) -> DataFrame:
    """(symbol, ts, pattern): shapes alone, without their context."""
    made = F.array(*[F.when(c, F.lit(name)) for name, (_, c, _) in shapes().items() if name not in ("hanging_man", "shooting_star")])
    rows = bars.withColumn("_made", F.filter(made, lambda x: x.isNotNull()))
    return rows.select(*keys(), "ts", F.explode("_made").alias("pattern"))


def candle_patterns(bars: DataFrame, levels: DataFrame | None = None, near: float = 0.01) -> DataFrame:
    """(symbol, ts, pattern, direction, reliability): shapes in their context.

    The context of a bullish pattern: at its first bar the five closes before fall strictly, or
    the bar's low lies within `near` of a support; bearish mirrored. At most 16 levels a series
    are gathered into an array, so no range join is needed. Of hammer and hanging man (and of
    their mirrors) the first that fits counts.
    """
    rows = numbered(bars).withColumn("_d", F.col("close") - F.lag("close").over(in_order()))
    past = in_order().rowsBetween(-4, -1)
    moves = lambda ok: (F.count(F.when(ok, 1)).over(past) == 4) & (F.col("n") > 5)
    down, up = moves(F.col("_d") < 0), moves(F.col("_d") > 0)
    if levels is not None:
        side = lambda kind: F.collect_list(F.when(F.col("level_type") == kind, F.col("price")))
        known = levels.groupBy(*keys()).agg(side("support").alias("_supports"), side("resistance").alias("_resistances"))
        rows = rows.join(known, [*keys()], "left")
        close_to = lambda c, x: F.coalesce(F.exists(c, lambda p: F.try_divide(F.abs(p - x), x) <= near), F.lit(False))
        down, up = down | close_to("_supports", F.col("low")), up | close_to("_resistances", F.col("high"))
    rows = rows.withColumns({"_bullish": down, "_bearish": up})
    listed = []
    for name, (needs, shape, back) in shapes().items():
        at = lambda c: F.coalesce(F.lag(c, back).over(in_order()) if back else F.col(c), F.lit(False))  # noqa: B023, E731
        ok = shape if needs == "any" else shape & at(f"_{needs}")
        if name in ("hanging_man", "shooting_star"):
            ok = ok & ~at("_bullish")
        direction = F.lit("neutral") if name == "doji" else F.when(F.col("close") > F.col("open"), "bullish").otherwise("bearish") if name == "marubozu" else F.lit(needs)
        listed.append(F.when(ok, F.struct(F.lit(name).alias("pattern"), direction.alias("direction"), F.lit(RELIABILITY[name]).alias("reliability"))))
    rows = rows.withColumn("_made", F.filter(F.array(*listed), lambda x: x.isNotNull()))
    return rows.select(*keys(), "ts", F.explode("_made").alias("x")).select(*keys(), "ts", "x.*")
