"""Trade plans and entry zones against price levels: one row per series, its levels and candidates as arrays of that row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.tick import round_to_tick, tick_size
from tickloom.operators import indicators as ind
from tickloom.operators import recurrence as rec
from tickloom.operators.engine import LOOKBACK
from tickloom.operators.relational import MODES
from tickloom.operators.series import in_order, keys, ratio, rolling
from tickloom.operators.structure import fibonacci_levels

#: A target gives way to a resistance this strong within half an ATR.
STRONG = 60.0
#: Share of the usual daily volume that a position may take.
LIQUID = 0.02


def _tick(price: Column, how: str) -> Column:
    return round_to_tick(F.round(price, 4), how).cast("double")


def _last_bars(bars: DataFrame, mode: str) -> DataFrame:
    """The last bar of each series with atr, ema20, ema50, the lowest low of the mode's lookback, and the mean volume of 20 bars."""
    rows = rec.fold(bars, rec.atr("atr", 14), rec.ema("ema20", "close", 20), rec.ema("ema50", "close", 50))
    w = in_order()
    rows = rows.withColumns({"swing": F.min("low").over(w.rowsBetween(1 - LOOKBACK[mode], 0)), "usual_volume": rolling(F.avg, F.col("volume"), 20, w)})
    return ind.tail(rows, 1).select(*keys(), "ts", "high", "close", "atr", "ema20", "ema50", "swing", "usual_volume")


def _levels_of(levels: DataFrame, kind: str) -> DataFrame:
    """Per series its levels of a kind (support or resistance) as an array by price."""
    own = levels.filter(F.col("level_type") == kind)
    return own.groupBy(*keys()).agg(F.array_sort(F.collect_list(F.struct("price", "strength"))).alias(kind))


def level_plan(bars: DataFrame, levels: DataFrame, mode: str, capital: float = 100e6, lot: int = 100) -> DataFrame:
    """Per series, from its last bar: entry, stop, tp1 to tp3, rr, lots, snapped (how many targets gave way), capped, and which limit decides the lots (`bound`: risk, exposure or volume).

    As trade_plan(), and besides: the swing low is of the mode's own lookback; a target within
    half an ATR of the nearest resistance above the entry stops a tick below it, if that is
    stronger than STRONG; in swing mode the third is no higher than the 1.618 extension of the
    last swings, if that lies above the second; lots take no more than LIQUID of the mean volume
    of 20 bars. levels: price_levels() of the same bars; a series without levels has none to heed.
    """
    m = MODES[mode]
    last = _last_bars(bars, mode).join(_levels_of(levels, "resistance"), [*keys()], "left")
    last = last.join(fibonacci_levels(bars).select(*keys(), "e1618"), [*keys()], "left")
    last = last.withColumn("entry", _tick(F.col("close"), "nearest"))
    stop = F.greatest(F.col("swing") - 0.5 * F.col("atr"), F.col("entry") - m["k_atr"] * F.col("atr"), F.col("entry") * (1 - m["max_risk"]))
    last = last.withColumn("stop", _tick(stop, "down")).withColumn("risk", F.col("entry") - F.col("stop"))
    above = F.filter(F.coalesce("resistance", F.array().cast("array<struct<price:double,strength:double>>")), lambda x: x["price"] > F.col("entry"))
    last = last.withColumn("above", above)
    snaps = F.lit(0)
    for i, r in enumerate(m["tp"], 1):
        last = last.withColumn("_raw", F.col("entry") + r * F.col("risk"))
        near = F.array_min(F.transform("above", lambda x: F.struct(F.abs(x["price"] - F.col("_raw")).alias("far"), x["price"].alias("price"), x["strength"].alias("strength"))))
        last = last.withColumn("_near", near)
        snap = F.coalesce((F.col("_near.far") < 0.5 * F.col("atr")) & (F.col("_near.strength") > STRONG), F.lit(False))
        below = F.col("_near.price") - tick_size(F.round("_near.price", 4)).cast("double")
        last = last.withColumn(f"_snap{i}", snap).withColumn(f"tp{i}", _tick(F.when(F.col(f"_snap{i}"), below).otherwise(F.col("_raw")), "down"))
        snaps = snaps + F.col(f"_snap{i}").cast("int")
    cap = F.coalesce(F.col("e1618") > F.col("tp2"), F.lit(False)) & F.lit(mode == "swing")
    last = last.withColumn("capped", cap & (F.col("e1618") < F.col("tp3"))).withColumn("tp3", F.when(F.col("capped"), _tick(F.col("e1618"), "down")).otherwise(F.col("tp3")))
    limits = {
        "risk": F.when(F.col("risk") > 0, F.floor(ratio(F.lit(capital * m["risk"]), F.col("risk") * lot))),
        "exposure": F.floor(ratio(F.lit(capital * m["max_position"]), F.col("entry") * lot)),
        "volume": F.floor(F.col("usual_volume") * LIQUID / lot),
    }
    least = F.array_min(F.filter(F.array(*[F.struct(F.greatest(F.lit(0), x).cast("bigint").alias("lots"), F.lit(i).alias("at"), F.lit(n).alias("name")) for i, (n, x) in enumerate(limits.items())]), lambda x: x["lots"].isNotNull()))
    last = last.withColumn("_least", least)
    rr = F.round(ratio(F.col("tp2") - F.col("entry"), F.col("risk")), 2)
    return last.select(*keys(), "ts", "entry", "stop", "risk", "tp1", "tp2", "tp3", rr.alias("rr"), F.col("_least.lots").alias("lots"), F.col("_least.name").alias("bound"), snaps.alias("snapped"), "capped")


_CLUSTERS = "array<struct<last:double,weight:double,mass:double,sources:array<string>>>"


def clustered(candidates: Column, tolerance: Column) -> Column:
    """The best cluster (weight, price, sources) of an array of (price, source, weight): sorted by price, neighbours within the tolerance are chained; the heaviest cluster wins, of equals the dearer; its price is the weighted mean. Null without candidates."""

    def take(found: Column, c: Column) -> Column:
        top = F.try_element_at(found, F.lit(-1))
        alone = F.struct(c["price"].alias("last"), c["weight"].alias("weight"), (c["price"] * c["weight"]).alias("mass"), F.array(c["source"]).alias("sources"))
        grown = F.struct(c["price"].alias("last"), (top["weight"] + c["weight"]).alias("weight"), (top["mass"] + c["price"] * c["weight"]).alias("mass"), F.concat(top["sources"], F.array(c["source"])).alias("sources"))
        joins = F.coalesce(c["price"] - top["last"] <= tolerance, F.lit(False))
        return F.when(joins, F.concat(F.slice(found, 1, F.size(found) - 1), F.array(grown))).otherwise(F.concat(found, F.array(alone))).cast(_CLUSTERS)

    whole = F.aggregate(F.array_sort(candidates), F.array().cast(_CLUSTERS), take)
    return F.array_max(F.transform(whole, lambda x: F.struct(x["weight"].alias("weight"), (x["mass"] / x["weight"]).alias("price"), x["sources"].alias("sources"))))


def clustered_zone(bars: DataFrame, levels: DataFrame, mode: str, *, far: float = 0.1) -> DataFrame:
    """Per series, from its last bar: zone_low, zone_high, trigger, weight, sources.

    Candidates are the nearest support (its strength as weight), the means over 20 and 50 bars
    where they lie less than `far` below the close (60), the retracements 0.382, 0.5 and 0.618 of
    the last swings below the close (55 + 20 times the ratio) and, in day and scalping mode, the
    mean price by volume of the day (70). The best cluster within half an ATR is the zone's
    middle; it reaches a quarter of an ATR to both sides, on ticks outwards; the trigger is a
    tick above zone and high. A series without candidates or ATR has null.
    """
    last = _last_bars(bars, mode)
    if mode in ("day", "scalping"):
        last = last.join(ind.tail(bars.withColumn("vwap", ind.vwap()), 1).select(*keys(), "vwap"), [*keys()], "left")
    else:
        last = last.withColumn("vwap", F.lit(None).cast("double"))
    last = last.join(_levels_of(levels, "support"), [*keys()], "left").join(fibonacci_levels(bars).select(*keys(), "r382", "r500", "r618"), [*keys()], "left")
    close = F.col("close")
    support = F.try_element_at(F.filter("support", lambda x: x["price"] <= close), F.lit(-1))
    made = [("support", support["price"], support["strength"], F.lit(True))]
    made += [(e, F.col(e), F.lit(60.0), (F.col(e) < close) & (ratio(close - F.col(e), close) < far)) for e in ("ema20", "ema50")]
    made += [(name, F.col(name), F.lit(55 + 20 * r), F.col(name) < close) for name, r in (("r382", 0.382), ("r500", 0.5), ("r618", 0.618))]
    made += [("vwap", F.col("vwap"), F.lit(70.0), F.lit(True))]
    listed = F.array(*[F.when(ok & p.isNotNull(), F.struct(p.alias("price"), F.lit(s).alias("source"), w.alias("weight"))) for s, p, w, ok in made])
    last = last.withColumn("best", clustered(F.filter(listed, lambda x: x.isNotNull()), 0.5 * F.col("atr")))
    reach = 0.25 * F.col("atr")
    last = last.withColumns({"zone_low": _tick(F.col("best.price") - reach, "down"), "zone_high": _tick(F.col("best.price") + reach, "up")})
    dearer = F.col("high") + tick_size(F.round("high", 4)).cast("double")
    return last.select(*keys(), "ts", "zone_low", "zone_high", _tick(F.when(F.col("zone_high").isNotNull(), F.greatest("zone_high", dearer)), "up").alias("trigger"), F.col("best.weight").alias("weight"), F.col("best.sources").alias("sources"))
