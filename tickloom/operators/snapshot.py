"""The snapshot: the last bar of every series with all indicators, as five structs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.operators import latest
from tickloom.operators import recurrence as rec
from tickloom.operators.latest import EXTENSIONS, PIVOTS, RETRACEMENTS, SMA
from tickloom.operators.series import keys

EMA = (8, 13, 20, 21, 50, 200)
FIELDS: dict[str, tuple[str, ...]] = {
    "trend": (
        *(f"sma{n}" for n in SMA), *(f"ema{n}" for n in EMA), "macd", "signal", "histogram", "adx", "plus_di", "minus_di", "psar", "supertrend", "direction",
        "tenkan", "kijun", "senkou_a", "senkou_b", "chikou",
    ),
    "momentum": ("rsi", "divergence", "stoch_k", "stoch_d", "stoch_rsi_k", "stoch_rsi_d", "cci", "williams_r", "roc", "mfi"),
    "volatility": ("atr", "atr_percent", "bb_middle", "bb_upper", "bb_lower", "bb_bandwidth", "bb_percent_b", "kc_middle", "kc_upper", "kc_lower", "dc_upper", "dc_lower", "dc_middle", "hist_vol"),
    "volume": ("volume_ma", "relative_volume", "obv", "accum_dist", "vwap", "poc", "vah", "val"),
    "structure": (*PIVOTS, *RETRACEMENTS, *EXTENSIONS),
}


def snapshot(bars: DataFrame) -> DataFrame:
    """(key, ts, close, trend, momentum, volatility, volume, structure): one row per series, all of it in one fold.

    Fields are null where the series is too short or a ratio has a zero below; the volume
    profile is that of the last 250 bars, if there are ten; Fibonacci levels are there if the
    last swing high is above the last swing low.
    """
    rows = bars.select(*keys(), "ts", *[F.col(c).cast("double").alias(c) for c in ("high", "low", "close", "volume")], F.unix_date(F.to_date("ts")).alias("_day"))
    steps = [rec.ema(f"ema{n}", "close", n) for n in EMA]
    steps += [rec.macd(12, 26, 9), rec.adx(14), rec.psar(0.02, 0.02, 0.2), rec.supertrend(10, 3.0), rec.rsi("rsi", 14), rec.atr("atr", 14), rec.atr("kc_width", 10)]
    last = rec.fold(rows, *steps, latest.sliding(), latest.running(), latest.profile(), latest.fibonacci(), last=1)
    made = {
        "divergence": F.lit(None).cast("string"),  # a pivot needs bars after it
        "atr_percent": 100 * F.try_divide("atr", "close"),
        "kc_middle": F.col("ema20"),
        "kc_upper": F.col("ema20") + 2 * F.col("kc_width"),
        "kc_lower": F.col("ema20") - 2 * F.col("kc_width"),
    }
    return last.withColumns(made).select(*keys(), "ts", "close", *[F.struct(*fields).alias(name) for name, fields in FIELDS.items()])


def as_json(snapshots: DataFrame) -> DataFrame:
    """(symbol, ts, payload): the five structs as one JSON text, null fields left out."""
    return snapshots.select(*keys(), "ts", F.to_json(F.struct(*FIELDS)).alias("payload"))
