"""Alerts that fire once, with a state and an expiry per alert."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# The kinds of alerts.
KINDS = ("price_cross", "entry_zone", "sl_hit", "signal_new")
_STATE = "price double, fired boolean"
_OUT = "alert_id long, kind string, symbol string, at long, price double, status string"  # at: microseconds
#: Microseconds of a span of rows that is put in order as one group, rows of a run cut from it, and alerts that are held against a run at once.
SPAN, RUN, TOGETHER = 6 * 3_600_000_000, 1 << 14, 256
_RUN = "symbol string, nth long, at array<long>, price array<double>, action array<string>"  # nth: the first row's place in its span
_ALERT = ("alert_id", "kind", "low", "high", "long", "wanted", "until")
_MET = "alert_id long, kind string, low double, high double, long boolean, wanted string, until long, symbol string, at long, nth long, prior double, price double, action string"


def events_of(quotes: DataFrame, signals: DataFrame | None = None) -> DataFrame:
    """Quotes (symbol, ts, price) and signals (symbol, ts, action) as one stream for stream_alerts_once."""
    told = quotes.select("symbol", "ts", F.col("price").cast("double").alias("price"), F.lit(None).cast("string").alias("action"))
    return told if signals is None else told.unionByName(signals.select("symbol", "ts", F.lit(None).cast("double").alias("price"), "action"))


def alert_holds(kind: Column, *, price: Column, before: Column, action: Column, low: Column, high: Column, long: Column, wanted: Column) -> Column:
    """Whether a row fires an alert, `before` being the price before it. The rule of the stream as an expression, for batches.

    price_cross: the price was below `low` and is at it or above, or was above and is at it or below.
    entry_zone: the price is within [low, high] and was not, or there was none.
    sl_hit: at or below `low` (long), at or above it (short). signal_new: a signal whose action is `wanted`, or any if that is null.
    """
    cross = ((before < low) & (price >= low)) | ((before > low) & (price <= low))
    zone = price.between(low, high) & (before.isNull() | ~before.between(low, high))
    hit = F.when(long, price <= low).otherwise(price >= low)
    signal = action.isNotNull() & (wanted.isNull() | (action == wanted))
    return F.coalesce(F.when(kind == "price_cross", cross).when(kind == "entry_zone", zone).when(kind == "sl_hit", hit).when(kind == "signal_new", signal), F.lit(False))


def _fires(kind: str, price: float | None, before: float | None, action: str | None, low: float, high: float, long: bool, wanted: str | None) -> bool:
    if kind == "signal_new":
        return action is not None and (wanted is None or action == wanted)
    if price is None:
        return False
    if kind == "price_cross":
        return before is not None and (before < low <= price or before > low >= price)
    if kind == "entry_zone":
        return low <= price <= high and (before is None or not low <= before <= high)
    return price <= low if long else price >= low


class _Runs(StatefulProcessor):
    """Runs of rows in order of time, from the rows of one span of a symbol; it keeps no state, and Spark drops late rows before it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        pass

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["at", "event_order"], kind="stable")
        at, price, action = own["at"].to_numpy(), own["price"].to_numpy(np.float64), own["action"].to_numpy(object)
        for n in range(0, len(own), RUN):
            yield pd.DataFrame({"symbol": [key[0]], "nth": [n], "at": [at[n : n + RUN]], "price": [price[n : n + RUN]], "action": [action[n : n + RUN]]})

    def close(self) -> None:
        pass


def _first_fire(kind: str, price: np.ndarray, action: pa.Array, priced: np.ndarray, low: float, high: float, long: bool, wanted: str | None) -> int | None:
    """The first row of a run that fires, `priced` being its rows with a price; what a crossing's first price comes from is not known here."""
    if kind == "signal_new":
        fires = (pc.is_valid(action) if wanted is None else pc.fill_null(pc.equal(action, wanted), False)).to_numpy(zero_copy_only=False)
        return int(fires.argmax()) if fires.any() else None
    now = price[priced]
    if kind == "price_cross":
        before, now, priced = now[:-1], now[1:], priced[1:]
        fires = (before < low) & (now >= low) | (before > low) & (now <= low)
    elif kind == "entry_zone":
        inside = (low <= now) & (now <= high)
        fires, priced = inside[1:] & ~inside[:-1], priced[1:]
    else:
        fires = now <= low if long else now >= low
    return int(priced[fires.argmax()]) if fires.any() else None


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run the rows that an alert needs: the first and the last with a price and the first that fires, each with the price before it (`prior`) if the run has it."""
    schema = pa.schema([(name, {"long": pa.int64(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}[kind]) for name, kind in (c.split() for c in _MET.split(", "))])
    for batch in batches:
        out = []
        for symbol, nth, ats, prices, actions, alerts in zip(*(batch.column(c) for c in ("symbol", "nth", "at", "price", "action", "alerts"))):
            at, price, action = ats.values.to_numpy(), prices.values.to_numpy(zero_copy_only=False), actions.values
            every = np.flatnonzero(~np.isnan(price))
            for alert in alerts.as_py():
                n = len(at) if alert["until"] is None else int(np.searchsorted(at, alert["until"], "right"))
                if n == 0:
                    continue
                priced = every[: np.searchsorted(every, n)]
                low, high = (np.nan if alert[c] is None else alert[c] for c in ("low", "high"))
                hit = _first_fire(alert["kind"], price[:n], action[:n], priced, low, high, alert["long"], alert["wanted"])
                kept = {int(i) for i in (*priced[:1], *priced[-1:])} | ({hit} if hit is not None else set()) or {0}
                for i in sorted(kept):
                    k = int(np.searchsorted(priced, i))
                    prior, value = None if k == 0 else float(price[priced[k - 1]]), None if np.isnan(price[i]) else float(price[i])
                    out.append({**alert, "symbol": symbol.as_py(), "at": int(at[i]), "nth": nth.as_py() + i, "prior": prior, "price": value, "action": action[i].as_py()})
        yield pa.RecordBatch.from_pylist(out, schema)


class _Alert(StatefulProcessor):
    """State per alert: the last price seen, and whether it has fired; a timer ends it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("alert", _STATE)
        self.about = handle.getValueState("about", "kind string, symbol string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["at", "nth"], kind="stable")
        first = own.iloc[0]
        known = self.state.get() if self.state.exists() else None
        before, fired = (None, False) if known is None else known
        if known is None:
            self.about.update((first["kind"], first["symbol"]))
            if not pd.isna(first["until"]):
                self.handle.registerTimer(int(first["until"]) // 1000)
        hit = None
        if not fired:
            wanted = None if pd.isna(first["wanted"]) else first["wanted"]
            for at, prior, price, action in zip(own["at"], own["prior"], own["price"], own["action"]):
                price, action = None if pd.isna(price) else float(price), None if pd.isna(action) else action
                if _fires(first["kind"], price, before if pd.isna(prior) else prior, action, first["low"], first["high"], bool(first["long"]), wanted):
                    hit = int(at), price
                    break
                before = before if price is None else price
        self.state.update((before, fired or hit is not None))
        if hit is not None:
            yield self._told(key[0], first["kind"], first["symbol"], *hit, "fired")

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        fired = self.state.exists() and self.state.get()[1]
        kind, symbol = self.about.get() if self.about.exists() else (None, None)
        self.state.clear()
        self.about.clear()
        if not fired:
            yield self._told(key[0], kind, symbol, expiredTimerInfo.getExpiryTimeInMs() * 1000, None, "expired")

    @staticmethod
    def _told(*row) -> pd.DataFrame:
        return pd.DataFrame([row], columns=[c.split()[0] for c in _OUT.split(", ")]).astype({"alert_id": "int64", "at": "int64", "price": "float64"})

    def close(self) -> None:
        pass


def stream_alerts_once(events: DataFrame, alerts: DataFrame, *, late: str = "10 minutes", span: int = SPAN) -> DataFrame:
    """(alert_id, kind, symbol, ts, price, status): each alert once, when it fires ("fired") or its time is over ("expired").

    events: a stream of events_of(). alerts: a table alert_id, symbol, kind, low, high, long,
    wanted, expires; see alert_holds() for what fires. Once an alert has fired, nothing fires it
    again, in this run or after a restart from the same checkpoint. Rows after `expires` (null:
    never) fire nothing; the alert is reported expired once the watermark has passed it, if any
    row of its symbol came before. Rows of an alert are taken in order of time within a
    micro-batch; late ones beyond `late` are dropped. A row is shuffled once, whatever the number
    of alerts: spans of `span` microseconds share out the rows of a symbol and are held against
    its alerts where they are, and an alert's state gets at most three rows of a run. The state
    store must be RocksDB.
    """
    slim = alerts.select(F.col("alert_id").cast("long").alias("alert_id"), "symbol", "kind", F.col("low").cast("double").alias("low"), F.col("high").cast("double").alias("high"), F.coalesce("long", F.lit(True)).alias("long"), F.col("wanted").cast("string").alias("wanted"), F.unix_micros(F.col("expires").cast("timestamp")).alias("until"))
    marked = events.withWatermark("ts", late).withColumns({"at": F.unix_micros("ts"), "event_order": F.when(F.col("price").isNull(), 1).otherwise(0)})
    wanted = marked.join(slim.select("symbol").distinct(), "symbol", "left_semi").withColumn("span", F.floor(F.col("at") / span))
    runs = wanted.groupBy("symbol", "span").transformWithStateInPandas(_Runs(), _RUN, "Append", "EventTime")
    parts = slim.groupBy("symbol").agg(F.ceil(F.count("*") / TOGETHER).alias("parts"))
    sets = slim.join(parts, "symbol").groupBy("symbol", F.pmod(F.xxhash64("alert_id"), "parts").alias("part")).agg(F.collect_list(F.struct(*_ALERT)).alias("alerts"))
    met = runs.join(sets.drop("part"), "symbol").mapInArrow(_met, _MET)
    told = met.groupBy("alert_id").transformWithStateInPandas(_Alert(), _OUT, "Append", "EventTime")
    return told.select("alert_id", "kind", "symbol", F.timestamp_micros("at").alias("ts"), "price", "status")
