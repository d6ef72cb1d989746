"""Trend, momentum, volatility and volume indicators: bars in, bars with columns out, all series at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.operators import recurrence as rec
from tickloom.operators.series import in_order, keys, numbered, of_series, ratio, rolling, so_far

# --- trend ---


def sma(n: int, x: str = "close") -> Column:
    return rolling(F.avg, F.col(x), n, in_order())


def add_ema(bars: DataFrame, *spans: int) -> DataFrame:
    return rec.fold(bars, *[rec.ema(f"ema{span}", "close", span) for span in spans])


def add_macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    return rec.fold(bars, rec.macd(fast, slow, signal))


def true_range() -> Column:
    before = F.lag("close").over(in_order())
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def add_atr(bars: DataFrame, n: int = 14, name: str = "atr") -> DataFrame:
    return rec.fold(bars, rec.atr(name, n))


def add_adx(bars: DataFrame, n: int = 14) -> DataFrame:
    return rec.fold(bars, rec.adx(n))


def add_psar(bars: DataFrame, start: float = 0.02, step: float = 0.02, most: float = 0.2) -> DataFrame:
    return rec.fold(bars, rec.psar(start, step, most))


def add_supertrend(bars: DataFrame, period: int = 10, times: float = 3.0) -> DataFrame:
    return rec.fold(bars, rec.supertrend(period, times))


def add_ichimoku(bars: DataFrame, fast: int = 9, slow: int = 26, wide: int = 52) -> DataFrame:
    middle = lambda n: (rolling(F.max, F.col("high"), n, in_order()) + rolling(F.min, F.col("low"), n, in_order())) / 2
    rows = bars.withColumns({"tenkan": middle(fast), "kijun": middle(slow), "_wide": middle(wide)})
    return rows.withColumns(
        {
            "senkou_a": F.lag((F.col("tenkan") + F.col("kijun")) / 2, slow).over(in_order()),
            "senkou_b": F.lag("_wide", slow).over(in_order()),
            "chikou": F.lead("close", slow).over(in_order()),
        }
    ).drop("_wide")


# --- momentum ---


def add_rsi(bars: DataFrame, n: int = 14, name: str = "rsi") -> DataFrame:
    """100 where there are no losses, flat series included."""
    return rec.fold(bars, rec.rsi(name, n))


def fractal(x: Column, n: int, highest: bool) -> Column:
    """Whether the row's value is the only extreme of itself and n rows on each side, all there."""
    left, right, both = in_order().rowsBetween(-n, -1), in_order().rowsBetween(1, n), in_order().rowsBetween(-n, n)
    fn = F.max if highest else F.min
    sides = F.greatest(fn(x).over(left), fn(x).over(right)) if highest else F.least(fn(x).over(left), fn(x).over(right))
    return F.coalesce((F.count(x).over(both) == 2 * n + 1) & (x > sides if highest else x < sides), F.lit(False))


def add_divergence(bars: DataFrame, n: int = 3, lookback: int = 20) -> DataFrame:
    """Label on the pivot bar: two fractals of one kind at most `lookback` bars apart where price and RSI disagree."""
    rows = numbered(add_rsi(bars)).withColumns({"_low": fractal(F.col("close"), n, False), "_high": fractal(F.col("close"), n, True)})
    for kind in ("_low", "_high"):
        kept = of_series(kind).orderBy("ts")
        rows = rows.withColumns({f"{kind}_{c}": F.when(F.col(kind), F.lag(c).over(kept)) for c in ("n", "close", "rsi")})
    near = lambda kind: F.col(kind) & (F.col("n") - F.col(f"{kind}_n") <= lookback)
    bullish = near("_low") & (F.col("close") < F.col("_low_close")) & (F.col("rsi") > F.col("_low_rsi"))
    bearish = near("_high") & (F.col("close") > F.col("_high_close")) & (F.col("rsi") < F.col("_high_rsi"))
    made = [c for k in ("_low", "_high") for c in (k, f"{k}_n", f"{k}_close", f"{k}_rsi")]
    return rows.withColumn("divergence", F.when(bullish, "bullish").when(bearish, "bearish")).drop(*made)


def _stochastic(rows: DataFrame, x: Column, high: Column, low: Column, k: int, smooth: int, d: int, names: tuple[str, str]) -> DataFrame:
    lowest, highest = rolling(F.min, low, k, in_order()), rolling(F.max, high, k, in_order())
    rows = rows.withColumn("_raw", 100 * ratio(x - lowest, highest - lowest))
    rows = rows.withColumn(names[0], rolling(F.avg, F.col("_raw"), smooth, in_order()))
    return rows.withColumn(names[1], rolling(F.avg, F.col(names[0]), d, in_order())).drop("_raw")


def add_stochastic(bars: DataFrame, k: int = 14, smooth: int = 3, d: int = 3) -> DataFrame:
    return _stochastic(bars, F.col("close"), F.col("high"), F.col("low"), k, smooth, d, ("stoch_k", "stoch_d"))


def add_stoch_rsi(bars: DataFrame, n: int = 14, k: int = 14, smooth: int = 3, d: int = 3) -> DataFrame:
    r = F.col("rsi")
    return _stochastic(bars if "rsi" in bars.columns else add_rsi(bars, n), r, r, r, k, smooth, d, ("stoch_rsi_k", "stoch_rsi_d"))


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def add_cci(bars: DataFrame, n: int = 20) -> DataFrame:
    frame = in_order().rowsBetween(1 - n, 0)
    rows = bars.withColumn("_tp", typical_price()).withColumns({"_all": F.collect_list("_tp").over(frame), "_mean": F.avg("_tp").over(frame)})
    away = F.aggregate("_all", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_mean"))) / n
    return rows.withColumn("cci", F.when(F.size("_all") == n, ratio(F.col("_tp") - F.col("_mean"), 0.015 * away))).drop("_tp", "_all", "_mean")


def williams_r(n: int = 14) -> Column:
    highest, lowest = rolling(F.max, F.col("high"), n, in_order()), rolling(F.min, F.col("low"), n, in_order())
    return -100 * ratio(highest - F.col("close"), highest - lowest)


def roc(n: int = 12) -> Column:
    return 100 * ratio(F.col("close") - F.lag("close", n).over(in_order()), F.lag("close", n).over(in_order()))


def add_mfi(bars: DataFrame, n: int = 14) -> DataFrame:
    rows = bars.withColumn("_tp", typical_price())
    rows = rows.withColumns({"_d": F.coalesce(F.col("_tp") - F.lag("_tp").over(in_order()), F.lit(0.0)), "_flow": F.col("_tp") * F.col("volume")})
    gain = rolling(F.sum, F.when(F.col("_d") > 0, F.col("_flow")).otherwise(0.0), n, in_order())
    loss = rolling(F.sum, F.when(F.col("_d") < 0, F.col("_flow")).otherwise(0.0), n, in_order())
    rows = rows.withColumns({"_gain": gain, "_loss": loss})
    mfi = F.when(F.col("_loss") == 0, 100.0).otherwise(100 - 100 / (1 + ratio(F.col("_gain"), F.col("_loss"))))
    return rows.withColumn("mfi", mfi).drop("_tp", "_d", "_flow", "_gain", "_loss")


# --- volatility ---


def add_bollinger(bars: DataFrame, n: int = 20, times: float = 2.0) -> DataFrame:
    rows = bars.withColumns({"bb_middle": sma(n), "_sd": rolling(F.stddev_pop, F.col("close"), n, in_order())})
    rows = rows.withColumns({"bb_upper": F.col("bb_middle") + times * F.col("_sd"), "bb_lower": F.col("bb_middle") - times * F.col("_sd")})
    width = F.col("bb_upper") - F.col("bb_lower")
    return rows.withColumns({"bb_bandwidth": 100 * ratio(width, F.col("bb_middle")), "bb_percent_b": ratio(F.col("close") - F.col("bb_lower"), width)}).drop("_sd")


def add_keltner(bars: DataFrame, n: int = 20, atr: int = 10, times: float = 2.0) -> DataFrame:
    rows = rec.fold(bars, rec.atr("_atr", atr), rec.ema("kc_middle", "close", n))
    return rows.withColumns({"kc_upper": F.col("kc_middle") + times * F.col("_atr"), "kc_lower": F.col("kc_middle") - times * F.col("_atr")}).drop("_atr")


def add_donchian(bars: DataFrame, n: int = 20) -> DataFrame:
    rows = bars.withColumns({"dc_upper": rolling(F.max, F.col("high"), n, in_order()), "dc_lower": rolling(F.min, F.col("low"), n, in_order())})
    return rows.withColumn("dc_middle", (F.col("dc_upper") + F.col("dc_lower")) / 2)


def add_historical_volatility(bars: DataFrame, n: int = 20, year: int = 252) -> DataFrame:
    rows = bars.withColumn("_r", F.ln(ratio(F.col("close"), F.lag("close").over(in_order()))))
    return rows.withColumn("hist_vol", rolling(F.stddev_pop, F.col("_r"), n, in_order()) * F.lit(year**0.5 * 100)).drop("_r")


def add_chandelier(bars: DataFrame, n: int = 22, times: float = 3.0) -> DataFrame:
    rows = add_atr(bars, n, "_atr").withColumn("_hh", rolling(F.max, F.col("high"), n, in_order()))
    return rows.withColumn("chandelier", F.col("_hh") - times * F.col("_atr")).drop("_atr", "_hh")


# --- volume ---


def relative_volume(n: int = 20) -> Column:
    return ratio(F.col("volume").cast("double"), rolling(F.avg, F.col("volume"), n, in_order()))


def add_obv(bars: DataFrame) -> DataFrame:
    rows = bars.withColumn("_s", F.coalesce(F.signum(F.col("close") - F.lag("close").over(in_order())), F.lit(0.0)) * F.col("volume"))
    return rows.withColumn("obv", F.sum("_s").over(so_far(in_order()))).drop("_s")


def add_accumulation_distribution(bars: DataFrame) -> DataFrame:
    rows = bars.withColumn("_m", F.when(F.col("high") == F.col("low"), 0.0).otherwise(ratio((F.col("close") - F.col("low")) - (F.col("high") - F.col("close")), F.col("high") - F.col("low"))) * F.col("volume"))
    return rows.withColumn("accum_dist", F.sum("_m").over(so_far(in_order()))).drop("_m")


def vwap(session: Column | None = None) -> Column:
    """Volume-weighted mean price since the session began, by default the day of ts."""
    day = F.to_date("ts") if session is None else session
    w = so_far(of_series(day).orderBy("ts"))
    return ratio(F.sum(typical_price() * F.col("volume")).over(w), F.sum(F.col("volume")).over(w))


def anchored_vwap(anchor: Column) -> Column:
    """Volume-weighted mean price since the anchor; null before it."""
    since = F.col("ts") >= anchor
    w = so_far(in_order())
    return ratio(F.sum(F.when(since, typical_price() * F.col("volume"))).over(w), F.sum(F.when(since, F.col("volume"))).over(w))


def tail(bars: DataFrame, n: int) -> DataFrame:
    """The last n bars of each series."""
    latest = of_series().orderBy(F.desc("ts"))
    return bars.withColumn("_r", F.row_number().over(latest)).filter(F.col("_r") <= n).drop("_r")


def volume_buckets(bars: DataFrame, buckets: int = 50, last: int | None = 250) -> DataFrame:
    """(symbol, bucket, price_low, price_high, volume): volume by typical price in equal buckets between the lowest low and the highest high."""
    rows = (bars if last is None else tail(bars, last)).select(*keys(), typical_price().alias("tp"), "high", "low", "volume").filter("tp IS NOT NULL")
    span = rows.groupBy(*keys()).agg(F.min("low").alias("lo"), F.max("high").alias("hi"))
    # a series' span is one row per symbol
    met = rows.select(*keys(), "tp", "volume").join(span, [*keys()])
    bucket = F.when(F.col("lo") == F.col("hi"), 1).otherwise(F.least(F.width_bucket("tp", "lo", "hi", F.lit(buckets)), F.lit(buckets))).cast("int")
    sums = met.groupBy(*keys(), "lo", "hi", bucket.alias("bucket")).agg(F.sum("volume").alias("volume"))
    width = (F.col("hi") - F.col("lo")) / buckets
    return sums.select(*keys(), "bucket", (F.col("lo") + (F.col("bucket") - 1) * width).alias("price_low"), (F.col("lo") + F.col("bucket") * width).alias("price_high"), "volume")


def value_area(bars: DataFrame, buckets: int = 50, last: int | None = 250, share: float = 0.7) -> DataFrame:
    """(symbol, poc, vah, val): the fullest bucket's middle (the lowest of equals) and the bounds of the buckets that hold `share` of the volume."""
    rows = volume_buckets(bars, buckets, last)
    order = of_series().orderBy(F.desc("volume"), "bucket")
    all_of = of_series()
    rows = rows.withColumns({"_rank": F.row_number().over(order), "_cum": F.sum("volume").over(so_far(order)), "_all": F.sum("volume").over(all_of)})
    rows = rows.filter((F.col("_rank") == 1) | (F.col("_cum") - F.col("volume") < share * F.col("_all")))
    middle = (F.col("price_low") + F.col("price_high")) / 2
    return rows.groupBy(*keys()).agg(F.max(F.when(F.col("_rank") == 1, middle)).alias("poc"), F.max("price_high").alias("vah"), F.min("price_low").alias("val"))
