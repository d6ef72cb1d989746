"""Chart patterns over sequences of swings: heads and shoulders by an ordered match, triangles and wedges by fitted lines.

A swing is the only extreme of five bars on each side, so a pattern is known five bars after its
last swing: `confirmed` is that bar. All is windows over the swings of a series, of which there
are far fewer than bars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators.series import in_order, keys, numbered, of_series, ratio
from tickloom.operators.structure import add_swings

#: Shoulders lie within this share of each other; a line is flat below this share of the price per bar.
SHOULDERS, FLAT = 0.05, 0.0005
_OUT = ("pattern", "direction", "breakout_level", "measured_target")


def swing_sequence(bars: DataFrame, n: int = 5) -> DataFrame:
    """(key, ts, n, kind, price, confirmed) of the swings in order of time; a bar that is both comes as high, then low."""
    rows = add_swings(numbered(bars), n).withColumn("confirmed", F.lead("ts", n).over(in_order()))
    both = F.array(F.when(F.col("swing_high"), F.struct(F.lit("high").alias("kind"), F.col("high").alias("price"))), F.when(F.col("swing_low"), F.struct(F.lit("low").alias("kind"), F.col("low").alias("price"))))
    return rows.select(*keys(), "ts", "n", "confirmed", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("x")).select(*keys(), "ts", "n", "confirmed", "x.*")


def _pattern(name: str, direction: str, level: Column, target: Column) -> Column:
    return F.struct(F.lit(name).alias("pattern"), F.lit(direction).alias("direction"), level.alias("breakout_level"), target.alias("measured_target"))


def head_and_shoulders(swings: DataFrame, shoulders: float = SHOULDERS) -> DataFrame:
    """The last five swings alternate, the middle one goes beyond the first and the last, and these lie within `shoulders` of each other.

    The neckline runs through the second and the fourth; the breakout level is the neckline at
    the last swing, the target as far beyond it as the head is from the neckline.
    """
    w = of_series().orderBy("n", "kind")
    rows = swings.withColumns({f"{c}{k}": F.lag(c, k).over(w) for k in (1, 2, 3, 4) for c in ("kind", "price", "n")})
    turns = (F.col("kind") == F.col("kind2")) & (F.col("kind") == F.col("kind4")) & (F.col("kind1") == F.col("kind3")) & (F.col("kind") != F.col("kind1"))
    level = F.abs(ratio(F.col("price"), F.col("price4")) - 1) <= shoulders
    slope = ratio(F.col("price1") - F.col("price3"), (F.col("n1") - F.col("n3")).cast("double"))
    neck = lambda at: F.col("price3") + slope * (F.col(at) - F.col("n3"))
    end, height = neck("n"), F.col("price2") - neck("n2")
    top = (F.col("kind") == "high") & (F.col("price2") > F.greatest("price", "price4")) & (height > 0)
    bottom = (F.col("kind") == "low") & (F.col("price2") < F.least("price", "price4")) & (height < 0)
    found = F.when(turns & level & top, _pattern("head_and_shoulders", "bearish", end, end - height)).when(turns & level & bottom, _pattern("inverse_head_and_shoulders", "bullish", end, end - height))
    return rows.withColumn("found", found).filter("found IS NOT NULL").select(*keys(), "ts", "confirmed", *[F.col(f"found.{c}").alias(c) for c in _OUT])


def triangles(swings: DataFrame, flat: float = FLAT) -> DataFrame:
    """The last six swings are three highs and three lows whose fitted lines come together but have not met.

    Lines rise, fall or are flat (less than `flat` of their mean price per bar). Flat highs over
    rising lows: ascending triangle; falling highs over flat lows: descending; falling over
    rising: symmetrical; both rising: rising wedge; both falling: falling wedge. The breakout level is
    the upper line at the last swing (the lower one for what breaks downwards), the target the
    width at the first of the six beyond it.
    """
    frame = of_series().orderBy("n", "kind").rowsBetween(-5, 0)
    fitted, x = {}, F.col("n").cast("double")
    for kind in ("high", "low"):
        own = F.when(F.col("kind") == kind, F.col("price"))
        at = F.when(F.col("kind") == kind, x)
        fitted |= {f"{kind}_slope": F.regr_slope(own, at).over(frame), f"{kind}_base": F.regr_intercept(own, at).over(frame), f"{kind}_mean": F.avg(own).over(frame), f"{kind}s": F.count(own).over(frame)}
    rows = swings.withColumns(fitted).withColumn("first", F.min("n").over(frame))
    line = lambda kind, at: F.col(f"{kind}_base") + F.col(f"{kind}_slope") * F.col(at)
    width = lambda at: line("high", at) - line("low", at)
    way = {k: ratio(F.col(f"{k}_slope"), F.col(f"{k}_mean")) for k in ("high", "low")}
    up = lambda k: way[k] > flat
    down = lambda k: way[k] < -flat
    level = lambda k: F.abs(way[k]) <= flat
    closing = (F.col("highs") == 3) & (F.col("lows") == 3) & (width("n") > 0) & (width("n") < width("first"))
    above, below = (line("high", "n"), line("high", "n") + width("first")), (line("low", "n"), line("low", "n") - width("first"))
    named = [
        (level("high") & up("low"), "ascending_triangle", "bullish", above), (down("high") & level("low"), "descending_triangle", "bearish", below), (down("high") & up("low"), "symmetrical_triangle", "neutral", above),
        (up("high") & up("low"), "rising_wedge", "bearish", below), (down("high") & down("low"), "falling_wedge", "bullish", above),
    ]
    found = F
    for ok, name, direction, (edge, target) in named:
        found = found.when(closing & ok, _pattern(name, direction, edge, target))
    return rows.withColumn("found", found).filter("found IS NOT NULL").select(*keys(), "ts", "confirmed", *[F.col(f"found.{c}").alias(c) for c in _OUT])


def chart_patterns(bars: DataFrame, n: int = 5) -> DataFrame:
    """(key, ts, confirmed, pattern, direction, breakout_level, measured_target) of all of these, ts being the last swing."""
    swings = swing_sequence(bars, n)
    return head_and_shoulders(swings).unionByName(triangles(swings))
