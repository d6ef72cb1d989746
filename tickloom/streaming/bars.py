"""Bars, session prices and running indicators over streams of ticks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tickloom.operators.series import keys
from tickloom.sources.store import merge_batch


def stream_bars(ticks: DataFrame, width: str = "1 hour", *, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Ticks (key, ts, price, volume) to bars over tumbling (or, with slide, sliding) windows; ticks later than `late` are dropped."""
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    bars = ticks.withWatermark("ts", late).groupBy(window.alias("w"), *keys()).agg(
        F.min_by("price", "ts").alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", "ts").alias("close"),
        F.sum("volume").alias("volume"),
    )
    return bars.select(*keys(), F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def stream_session_vwap(ticks: DataFrame, gap: str = "30 minutes", *, late: str = "10 minutes") -> DataFrame:
    """Volume-weighted mean price of each session, a session ending after `gap` without ticks."""
    sums = ticks.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), *keys()).agg(F.sum(F.col("price") * F.col("volume")).alias("pv"), F.sum("volume").alias("v"))
    return sums.select(*keys(), F.col("w.start").alias("start"), F.col("w.end").alias("stop"), F.try_divide("pv", "v").alias("vwap"))


def stream_ema(bars: DataFrame, span: int = 21) -> DataFrame:
    """(symbol, ts, ema) of closed bars, with one number of state per symbol."""
    alpha = 2 / (span + 1)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values("ts")
        out = []
        for close in rows["close"]:
            value = float(close) if value is None else (1 - alpha) * value + alpha * float(close)
            out.append(value)
        state.update((value,))
        yield pd.DataFrame({"symbol": rows["symbol"], "ts": rows["ts"], "ema": out})

    slim = bars.select("symbol", "ts", "close")
    return slim.groupBy("symbol").applyInPandasWithState(step, "symbol string, ts timestamp, ema double", "value double", "append", GroupStateTimeout.NoTimeout)


def stream_alerts(quotes: DataFrame, alerts: DataFrame) -> DataFrame:
    """Quotes (symbol, ts, price) that satisfy an alert (alert_id, symbol, kind price_above or price_below, level); a stream-static join."""
    hit = F.when(F.col("kind") == "price_above", F.col("price") >= F.col("level")).when(F.col("kind") == "price_below", F.col("price") <= F.col("level"))
    return quotes.join(alerts, "symbol").filter(hit).select("alert_id", "symbol", "ts", "price", "kind", "level")


def unique_ticks(ticks: DataFrame, *, key: str = "tick_id", late: str = "10 minutes") -> DataFrame:
    """Ticks without those that repeat a key within the watermark, and without late ones."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def merge_bars(path: str, *, writer: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that merges bars into the store at `path` (see sources/store.py)."""

    def sink(batch: DataFrame, number: int) -> None:
        merge_batch(batch, number, path, writer=writer)

    return sink
