"""Queries that replay tables as streams, and their twins over the same rows at once.

The time of a table is cut in three chunks, which arrive one after the other, each taken by a
query that starts from the checkpoint of the one before. Some rows of the end of a chunk come
with the next, within the watermark's delay; others come two chunks late, too late.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.series import micros
from tickloom.plans import oracle as sql
from tickloom.plans.oracle import EVENT, q, r
from tickloom.plans.registry import register, told
from tickloom.sources import bars as src
from tickloom.sources.store import stored_bars
from tickloom.streaming import alerts as al
from tickloom.streaming import bars as st
from tickloom.streaming import online
from tickloom.streaming.replay import replay, shared_folder

LATE = "12 hours"
_HOUR = 3_600_000_000


def _chunk(rows: DataFrame, ahead: int = 0) -> Column:
    """Which third of the table's time a row (or what comes `ahead` microseconds after it) lies in, from 0."""
    lo, hi = rows.agg(F.min(micros()), F.max(micros())).first()
    return F.floor(3 * (micros() + F.lit(ahead) - F.lit(lo or 0)) / F.lit((hi or 0) - (lo or 0) + 1))


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks with their arrival."""
    rows = src.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), "ts", F.col("value").alias("price"), F.lit(1).cast("bigint").alias("volume"))
    chunk, soon, k = _chunk(rows), _chunk(rows, 6 * _HOUR), F.col("event_id")
    late = F.when((k % 97 == 0) & (chunk < 2), 2).when((k % 7 == 0) & (soon > chunk), 1).otherwise(0)
    return rows.withColumn("arrival", chunk + late)


#: a: events with their arrival; w: the watermark that an arrival meets, 4 standing for the end.
_ARRIVED = f"""e AS (SELECT event_id, event_type AS symbol, ts, value, epoch_us(ts) AS us FROM events),
c AS (SELECT e.*, (3 * (us - lo)) // span AS chunk, (3 * (us + {6 * _HOUR} - lo)) // span AS soon FROM e, (SELECT min(us) AS lo, max(us) - min(us) + 1 AS span FROM e)),
a AS MATERIALIZED (SELECT *, chunk + CASE WHEN event_id % 97 = 0 AND chunk < 2 THEN 2 WHEN event_id % 7 = 0 AND soon > chunk THEN 1 ELSE 0 END AS arrival FROM c),
w AS MATERIALIZED (SELECT n AS arrival, max(us) // 1000 * 1000 - {12 * _HOUR} AS mark FROM a, (SELECT unnest(range(1, 5)) AS n) WHERE a.arrival < n GROUP BY 1),
t AS MATERIALIZED (SELECT a.*, mark FROM a LEFT JOIN w USING (arrival)),
f AS (SELECT mark AS ending FROM w WHERE arrival = 4)"""


def _windows(width: int, starts: str) -> str:
    return f"""WITH {_ARRIVED} SELECT symbol, make_timestamp(s) AS ts, {r('arg_min(value, us)', 'open')}, {r('max(value)', 'high')}, {r('min(value)', 'low')}, {r('arg_max(value, us)', 'close')}, count(*) AS volume
    FROM (SELECT *, us // {_HOUR} * {_HOUR} - {_HOUR} * unnest({starts}) AS s FROM t), f WHERE coalesce(s + {width} > mark, true) AND s + {width} <= ending GROUP BY symbol, s"""


_BARS = ("symbol", "ts", "open", "high", "low", "close", "volume")


@register("stream_bars", _windows(_HOUR, "[0]"))
def stream_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars of closed hours; ticks too late for their hour are lost."""
    return told(replay(_ticks(spark, sf_dir), lambda s: st.stream_bars(s, "1 hour", late=LATE), arrival=F.col("arrival")), *_BARS)


@register("stream_sliding", _windows(2 * _HOUR, "[0, 1]"))
def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hour bars every hour."""
    return told(replay(_ticks(spark, sf_dir), lambda s: st.stream_bars(s, "2 hours", slide="1 hour", late=LATE), arrival=F.col("arrival")), *_BARS)


@register(
    "stream_session_vwap",
    f"""WITH {_ARRIVED}, g AS (SELECT symbol, us, value, coalesce(us - lag(us) OVER (PARTITION BY symbol ORDER BY us) > {_HOUR // 2}, true) AS opens FROM t WHERE coalesce(us + {_HOUR // 2} > mark, true)),
    n AS (SELECT *, count(*) FILTER (WHERE opens) OVER (PARTITION BY symbol ORDER BY us) AS nth FROM g)
    SELECT symbol, make_timestamp(min(us)) AS start, make_timestamp(max(us) + {_HOUR // 2}) AS stop, {r('avg(value)', 'vwap')} FROM n, f GROUP BY symbol, nth, ending HAVING max(us) + {_HOUR // 2} <= ending""",
)
def stream_session_vwap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prices of closed sessions, half an hour without ticks ending one."""
    return told(replay(_ticks(spark, sf_dir), lambda s: st.stream_session_vwap(s, "30 minutes", late=LATE), arrival=F.col("arrival")), "symbol", "start", "stop", "vwap")


@register("stream_late", f"WITH {_ARRIVED} SELECT event_id, symbol, ts, {r('value', 'price')} FROM t WHERE coalesce(us > mark, true)")
def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tick in time once: a fifth of them are delivered twice, the second time one arrival later."""
    ticks = _ticks(spark, sf_dir)
    again = ticks.filter((F.col("event_id") % 5 == 0) & (F.col("arrival") < 3)).withColumn("arrival", F.col("arrival") + 1)
    once = replay(ticks.unionByName(again), lambda s: st.unique_ticks(s, key="event_id", late=LATE), arrival=F.col("arrival"))
    return told(once, "event_id", "symbol", "ts", "price")


_MACHINES = (online.Ema("ema21", 21), online.Macd(), online.Atr("atr", 14), online.Rsi("rsi", 14), online.Adx(14), online.Psar(), online.SuperTrend(10, 3.0))
_ONLINE = {"ema21": "g21.y", "macd": "md.macd", "signal": "e3.y", "histogram": "md.macd - e3.y", "atr": "wr.y", "rsi": "rsi.rsi", "adx": "wx.y", "plus_di": "plus_di", "minus_di": "minus_di", "psar": "CASE WHEN b.n > 1 THEN pr.sar END", "supertrend": "CASE WHEN sr.way = 'up' THEN sr.l ELSE sr.u END"}


@register(
    "stream_recurrences",
    q(
        f"""SELECT b.symbol, b.ts, {', '.join(r(e, k) for k, e in _ONLINE.items())}, coalesce(way, 'up') AS direction FROM b
        {' '.join(f'LEFT JOIN {t} ON {t}.symbol = b.symbol AND {t}.n = b.n' for t in ('g21', 'md', 'e3', 'rsi', 'wr', 'wx', 'di', 'pr', 'sr'))}""",
        sql.ema("g21", "b", "close", 21), sql.ema("e1", "b", "close", 12), sql.ema("e2", "b", "close", 26),
        "md AS MATERIALIZED (SELECT b.*, e1.y - e2.y AS macd FROM b JOIN e1 USING (symbol, n) JOIN e2 USING (symbol, n))", sql.ema("e3", "md", "macd", 9),
        *sql.RSI, *sql.ADX, sql.wilder("wr", "tr", "t", 14), *[c for c in sql.SUPERTREND if c != sql.TR], sql._PSAR, bars=EVENT,
    ),
)
def stream_recurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All recurrences bar by bar, over three arrivals with a restart between them."""
    bars = src.event_hour(spark, sf_dir).select("symbol", "ts", "high", "low", "close").cache()
    out = replay(bars, lambda s: online.stream_recurrences(s, *_MACHINES), arrival=_chunk(bars))
    bars.unpersist()
    return told(out, "symbol", "ts", *_ONLINE, "direction")


def _alerts(spark: SparkSession, sf_dir: str, events: DataFrame) -> DataFrame:
    """Four alerts for each nation, on the event types in turn."""
    types = [row[0] for row in events.select("symbol").distinct().orderBy("symbol").collect()]
    first = events.agg(F.min(micros())).first()[0] or 0
    k, kinds = F.col("n_nationkey"), F.array(*[F.lit(x) for x in al.KINDS])
    rows = src.table(spark, sf_dir, "nation").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(3))))
    low, until = (k * 7 % 60 + 5).cast("double"), first + (k % 10 * 3).cast("bigint") * 24 * _HOUR + _HOUR
    return rows.select(
        (k * 4 + F.col("i")).cast("bigint").alias("alert_id"), F.array(*[F.lit(x) for x in types])[k % F.lit(max(1, len(types)))].alias("symbol"), kinds[F.col("i")].alias("kind"), low.alias("low"), (low + 3).alias("high"),
        (k % 2 == 0).alias("long"), F.when(k % 3 == 0, "buy").when(k % 3 == 1, "sell").alias("wanted"), F.when(k % 10 != 9, until).alias("until"),
    )


@register(
    "stream_alerts_once",
    f"""WITH {_ARRIVED}, ty AS (SELECT symbol, row_number() OVER (ORDER BY symbol) - 1 AS i, count(*) OVER () AS types FROM (SELECT DISTINCT symbol FROM e)),
    al AS (SELECT n_nationkey * 4 + i AS alert_id, n_nationkey AS k, ['price_cross', 'entry_zone', 'sl_hit', 'signal_new'][i + 1] AS kind, (n_nationkey * 7 % 60 + 5)::double AS low,
      CASE WHEN n_nationkey % 10 <> 9 THEN (SELECT min(us) FROM e) + (n_nationkey % 10 * 3)::bigint * {24 * _HOUR} + {_HOUR} END AS til FROM nation, (SELECT unnest(range(0, 4))::int AS i)),
    ev AS (SELECT symbol, us, CASE WHEN event_id % 50 <> 0 THEN value END AS price, CASE WHEN event_id % 50 = 0 THEN (CASE WHEN value > 20 THEN 'buy' ELSE 'sell' END) END AS action FROM e),
    pv AS (SELECT *, last_value(price IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY us ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM ev),
    me AS MATERIALIZED (SELECT alert_id, kind, symbol, til, us, price, CASE kind WHEN 'price_cross' THEN before < low AND price >= low OR before > low AND price <= low
      WHEN 'entry_zone' THEN price BETWEEN low AND low + 3 AND (before IS NULL OR before NOT BETWEEN low AND low + 3) WHEN 'sl_hit' THEN CASE WHEN k % 2 = 0 THEN price <= low ELSE price >= low END
      ELSE action IS NOT NULL AND (k % 3 = 2 OR action = CASE k % 3 WHEN 0 THEN 'buy' ELSE 'sell' END) END AS hit
      FROM al JOIN ty ON ty.i = k % types JOIN pv USING (symbol) WHERE til IS NULL OR us <= til),
    fi AS (SELECT alert_id, kind, symbol, min(us) AS us, arg_min(price, us) AS price FROM me WHERE hit GROUP BY 1, 2, 3)
    SELECT alert_id::bigint AS alert_id, kind, symbol, make_timestamp(us) AS ts, {r('price')}, 'fired' AS status FROM fi
    UNION ALL SELECT DISTINCT alert_id::bigint, kind, symbol, make_timestamp(til // 1000 * 1000), NULL, 'expired' FROM me, f WHERE til <= ending AND alert_id NOT IN (SELECT alert_id FROM fi)""",
)
def stream_alerts_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices and, every fiftieth event, signals against a hundred alerts with and without expiry."""
    ticks = src.table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("symbol"), "ts", F.col("value"))
    table = _alerts(spark, sf_dir, ticks).collect()  # a hundred rows

    def make(stream: DataFrame) -> DataFrame:
        signal = F.col("event_id") % 50 == 0
        told_ = stream.select("symbol", "ts", F.when(~signal, F.col("value")).alias("price"), F.when(signal, F.when(F.col("value") > 20, "buy").otherwise("sell")).alias("action"))
        known = stream.sparkSession.createDataFrame(table, "alert_id bigint, symbol string, kind string, low double, high double, long boolean, wanted string, until bigint")
        return al.stream_alerts_once(told_, known.withColumn("expires", F.timestamp_micros("until")), late=LATE)

    return told(replay(ticks, make, arrival=_chunk(ticks)), "alert_id", "kind", "symbol", "ts", "price", "status")


@register("stream_store", f"WITH {sql.BRAND} SELECT symbol, ts, {r('CASE WHEN day(ts) <= 15 THEN close * 2 ELSE close END', 'close')} FROM bars")
def stream_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The store after bars have been merged batch by batch, the first half of each month a second time with other prices."""
    bars = src.brand_week(spark, sf_dir).select("symbol", "ts", "close").cache()
    first = bars.withColumn("arrival", _chunk(bars))
    again = bars.filter(F.dayofmonth("ts") <= 15).withColumns({"close": F.col("close") * 2, "arrival": F.lit(3).cast("bigint")})
    path = f"{shared_folder(spark)}/bars"
    replay(first.unionByName(again), lambda s: s, arrival=F.col("arrival"), sink=st.merge_bars(path, writer="stream_store"))
    bars.unpersist()
    return told(stored_bars(spark, path), "symbol", "ts", "close")
