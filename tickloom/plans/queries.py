"""The registered queries and their SQL twins, name by name. Doubles are rounded to six places on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.tick import round_to_tick, tick_size
from tickloom.operators import indicators as ind
from tickloom.operators import ranges as rng
from tickloom.operators import relational as rel
from tickloom.operators import screening as scr
from tickloom.operators import structure as st
from tickloom.operators import recurrence as rec
from tickloom.operators import snapshot as snap
from tickloom.operators.series import in_order, keyed_by, of_series
from tickloom.plans import oracle as sql
from tickloom.plans.oracle import B, EVENT, NATION, TP, lag, q, r, roll
from tickloom.plans.registry import ORACLE_SQL, QUERIES, column, on_bars, register, told
from tickloom.sources import bars as src

KEYS = "symbol, ts"
BAR_COLUMNS = ("symbol", "ts", "open", "high", "low", "close", "volume", "value", "frequency")
PRICES = ", ".join(r(c) for c in ("open", "high", "low", "close"))

# --- sources ---
on_bars("bars_brand_week", q(f"SELECT {KEYS}, {PRICES}, volume, {r('value')}, frequency FROM bars"), lambda b: b, *BAR_COLUMNS)
on_bars("bars_event_hour", q(f"SELECT {KEYS}, {PRICES}, volume, {r('value')}, frequency FROM bars", bars=EVENT), lambda b: b, *BAR_COLUMNS, source=src.event_hour)
on_bars("bars_nation_week", q(f"SELECT {KEYS}, sector, {PRICES}, volume, {r('value')}, frequency FROM bars", bars=NATION), lambda b: b, *BAR_COLUMNS, "sector", source=src.nation_week)
_RESAMPLED = "arg_min(open, ts) AS open, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close, cast(sum(volume) AS bigint) AS volume"
for unit, source, base in (("month", src.brand_week, sql.BRAND), ("week", src.event_hour, EVENT), ("day", src.event_hour, EVENT), ("4 hours", src.event_hour, EVENT)):
    _start = f"time_bucket(INTERVAL '{unit}', ts)" if unit[0].isdigit() else f"date_trunc('{unit}', ts)"
    on_bars(
        f"resample_{unit}".replace(" hours", "h"),
        q(f"SELECT symbol, t AS ts, {PRICES}, volume FROM (SELECT symbol, {_start}::timestamp AS t, {_RESAMPLED} FROM bars GROUP BY 1, 2)", bars=base),
        lambda b, unit=unit: src.resample(b, unit), "symbol", "ts", "open", "high", "low", "close", "volume", source=source,
    )


@register("symbol_codec", "SELECT upper(n_name) || '.JK' AS provider, upper(n_name) AS symbol FROM nation")
def symbol_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = src.nations(spark, sf_dir).select(src.to_provider_symbol(F.col("symbol")).alias("provider"))
    return coded.select("provider", src.from_provider_symbol(F.col("provider")).alias("symbol"))


@register("normalise_scan", f"WITH {EVENT} SELECT symbol, ts - INTERVAL 7 HOUR AS ts, {PRICES}, volume, {r('close * volume', 'value')}, cast(NULL AS bigint) AS frequency FROM (SELECT upper(symbol) AS symbol, * EXCLUDE (symbol) FROM bars)")
def normalise_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = src.event_hour(spark, sf_dir)
    return told(src.normalise(raw.select("symbol", "ts", *[F.col(c).alias(c.title()) for c in ("open", "high", "low", "close", "volume")])), *BAR_COLUMNS)


@register("upsert_latest", f"WITH {sql.BRAND} SELECT symbol, ts, {r('CASE WHEN day(ts) <= 15 THEN close * 2 ELSE close END', 'close')} FROM bars")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = src.brand_week(spark, sf_dir).select("symbol", "ts", "close")
    late = stored.filter(F.dayofmonth("ts") <= 15)
    load = late.withColumns({"close": F.col("close") * 3, "load_seq": F.lit(1)}).unionByName(late.withColumns({"close": F.col("close") * 2, "load_seq": F.lit(2)}))
    return told(src.upsert(stored, load, key=["symbol", "ts"]), "symbol", "ts", "close")


@register("upsert_instruments", """SELECT n_name AS symbol, 'X' AS exchange, CASE WHEN n_nationkey >= 10 AND n_nationkey < 20 THEN lower(n_name) WHEN n_nationkey < 20 THEN n_name ELSE lower(n_name) END AS name,
  CASE WHEN n_nationkey < 10 THEN 'kept' WHEN n_nationkey < 20 THEN 'updated' ELSE 'created' END AS outcome FROM nation""")
def upsert_instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = src.nations(spark, sf_dir).withColumns({"exchange": F.lit("X"), "is_active": F.lit(True), "name": F.col("symbol")})
    out = src.upsert_instruments(rows.filter("instrument_id < 20"), rows.filter("instrument_id >= 10").withColumn("name", F.lower("symbol")))
    return out.select("symbol", "exchange", "name", "outcome")


# --- trend ---
column("sma", q(f"SELECT {KEYS}, {r(roll('avg', 'close', 20), 'sma')} FROM b"), lambda: ind.sma(20))
on_bars("ema", q(f"SELECT b.symbol, ts, {r('e1.y', 'ema8')}, {r('e2.y', 'ema21')} FROM b JOIN e1 USING (symbol, n) JOIN e2 USING (symbol, n)", sql.ema("e1", "b", "close", 8), sql.ema("e2", "b", "close", 21)), lambda b: ind.add_ema(b, 8, 21), "symbol", "ts", "ema8", "ema21")
_EMAS = q(f"SELECT b.symbol, ts, {r('e1.y', 'ema8')}, {r('e2.y', 'ema21')} FROM b JOIN e1 USING (symbol, n) JOIN e2 USING (symbol, n)", sql.ema("e1", "b", "close", 8), sql.ema("e2", "b", "close", 21), bars=sql.GAPPY)
on_bars("ema_by_ranges", _EMAS, lambda b: rng.add_ema(gappy(b), 8, 21), "symbol", "ts", "ema8", "ema21")
on_bars(
    "macd",
    q(f"SELECT md.symbol, ts, {r('md.macd', 'macd')}, {r('e3.y', 'signal')}, {r('md.macd - e3.y', 'histogram')} FROM md JOIN e3 USING (symbol, n)", sql.ema("e1", "b", "close", 12), sql.ema("e2", "b", "close", 26), "md AS MATERIALIZED (SELECT b.*, e1.y - e2.y AS macd FROM b JOIN e1 USING (symbol, n) JOIN e2 USING (symbol, n))", sql.ema("e3", "md", "macd", 9)),
    ind.add_macd, "symbol", "ts", "macd", "signal", "histogram",
)
column("true_range", q(f"SELECT {KEYS}, {r('t', 'true_range')} FROM tr", sql.TR), ind.true_range)
on_bars("adx", q(f"SELECT symbol, ts, {r('wx.y', 'adx')}, {r('plus_di')}, {r('minus_di')} FROM b LEFT JOIN di USING (symbol, n) LEFT JOIN wx USING (symbol, n)", *sql.ADX), ind.add_adx, "symbol", "ts", "adx", "plus_di", "minus_di")
on_bars("psar", q(f"SELECT b.symbol, ts, {r('sar', 'psar')} FROM b LEFT JOIN pr USING (symbol, n)", sql._PSAR), ind.add_psar, "symbol", "ts", "psar")
_ST_LINE = r("CASE WHEN sr.way = 'up' THEN sr.l ELSE sr.u END", "supertrend")
on_bars("supertrend", q(f"SELECT b.symbol, ts, {_ST_LINE}, coalesce(way, 'up') AS direction FROM b LEFT JOIN sr USING (symbol, n)", *sql.SUPERTREND), ind.add_supertrend, "symbol", "ts", "supertrend", "direction")
_MID = lambda n: f"(({roll('max', 'high', n)}) + ({roll('min', 'low', n)})) / 2"
on_bars(
    "ichimoku",
    q(f"SELECT {KEYS}, {r('tenkan')}, {r('kijun')}, {r(lag('(tenkan + kijun) / 2', 26), 'senkou_a')}, {r(lag('wide', 26), 'senkou_b')}, {r('lead(close, 26) OVER (PARTITION BY symbol ORDER BY ts)', 'chikou')} FROM (SELECT *, {_MID(9)} AS tenkan, {_MID(26)} AS kijun, {_MID(52)} AS wide FROM b)"),
    ind.add_ichimoku, "symbol", "ts", "tenkan", "kijun", "senkou_a", "senkou_b", "chikou",
)

# --- momentum ---
on_bars("rsi", q(f"SELECT {KEYS}, {r('rsi')} FROM rsi", *sql.RSI), ind.add_rsi, "symbol", "ts", "rsi")
_FR = f"fr AS MATERIALIZED (SELECT *, {sql.fractal('close', 3, False)} AS fl, {sql.fractal('close', 3, True)} AS fh FROM rsi)"
_PV = lambda f: f"(SELECT symbol, n, close, rsi, lag(n) OVER w AS pn, lag(close) OVER w AS pc, lag(rsi) OVER w AS pr FROM fr WHERE {f} WINDOW w AS (PARTITION BY symbol ORDER BY ts))"
on_bars(
    "rsi_divergence",
    q(
        f"""SELECT b.symbol, b.ts, CASE WHEN lo.n IS NOT NULL THEN 'bullish' WHEN hi.n IS NOT NULL THEN 'bearish' END AS divergence FROM b
        LEFT JOIN (SELECT * FROM {_PV('fl')} WHERE n - pn <= 20 AND close < pc AND rsi > pr) lo USING (symbol, n)
        LEFT JOIN (SELECT * FROM {_PV('fh')} WHERE n - pn <= 20 AND close > pc AND rsi < pr) hi USING (symbol, n)""",
        *sql.RSI, _FR,
    ),
    ind.add_divergence, "symbol", "ts", "divergence",
)
on_bars("stochastic", q(f"SELECT {KEYS}, {r('k', 'stoch_k')}, {r('dd', 'stoch_d')} FROM s3", *sql._stochastic("close", "high", "low", "b")), ind.add_stochastic, "symbol", "ts", "stoch_k", "stoch_d")
on_bars("stoch_rsi", q(f"SELECT {KEYS}, {r('k', 'stoch_rsi_k')}, {r('dd', 'stoch_rsi_d')} FROM s3", *sql.RSI, *sql._stochastic("rsi", "rsi", "rsi", "rsi")), ind.add_stoch_rsi, "symbol", "ts", "stoch_rsi_k", "stoch_rsi_d")
on_bars(
    "cci",
    q(f"""SELECT t.symbol, t.ts, {r('CASE WHEN count(u.tp) = 20 THEN (t.tp - t.m) / nullif(0.015 * avg(abs(u.tp - t.m)), 0) END', 'cci')} FROM tm t JOIN tm u ON u.symbol = t.symbol AND u.n BETWEEN t.n - 19 AND t.n GROUP BY t.symbol, t.ts, t.tp, t.m""", f"tm AS MATERIALIZED (SELECT symbol, ts, n, {TP} AS tp, avg({TP}) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS m FROM b)"),
    ind.add_cci, "symbol", "ts", "cci",
)
_HH, _LL = roll("max", "high", 14), roll("min", "low", 14)
column("williams_r", q(f"SELECT {KEYS}, {r(f'-100 * (({_HH}) - close) / nullif(({_HH}) - ({_LL}), 0)', 'williams_r')} FROM b"), ind.williams_r)
column("roc", q(f"SELECT {KEYS}, {r(f'100 * (close - {lag('close', 12)}) / nullif({lag('close', 12)}, 0)', 'roc')} FROM b"), ind.roc)
_MF = [
    f"m1 AS MATERIALIZED (SELECT *, {TP} AS tp, coalesce({TP} - lag({TP}) OVER (PARTITION BY symbol ORDER BY ts), 0) AS dd FROM b)",
    f"m2 AS MATERIALIZED (SELECT *, {roll('sum', '(CASE WHEN dd > 0 THEN tp * volume ELSE 0 END)', 14)} AS gain, {roll('sum', '(CASE WHEN dd < 0 THEN tp * volume ELSE 0 END)', 14)} AS loss FROM m1)",
]
on_bars("mfi", q(f"SELECT {KEYS}, {r('CASE WHEN loss = 0 THEN 100 ELSE 100 - 100 / (1 + gain / loss) END', 'mfi')} FROM m2", *_MF), ind.add_mfi, "symbol", "ts", "mfi")

# --- volatility ---
on_bars("atr", q(f"SELECT tr.symbol, ts, {r('wa.y', 'atr')}, {r('100 * wa.y / nullif(close, 0)', 'atr_percent')} FROM tr LEFT JOIN wa USING (symbol, n)", sql.TR, sql.wilder("wa", "tr", "t", 14)), lambda b: ind.add_atr(b).withColumn("atr_percent", 100 * F.try_divide("atr", "close")), "symbol", "ts", "atr", "atr_percent")
on_bars(
    "bollinger",
    q(f"SELECT {KEYS}, {r('m', 'bb_middle')}, {r('m + 2 * s', 'bb_upper')}, {r('m - 2 * s', 'bb_lower')}, {r('100 * 4 * s / nullif(m, 0)', 'bb_bandwidth')}, {r('(close - (m - 2 * s)) / nullif((m + 2 * s) - (m - 2 * s), 0)', 'bb_percent_b')} FROM (SELECT *, {roll('avg', 'close', 20)} AS m, {roll('stddev_pop', 'close', 20)} AS s FROM b)"),
    ind.add_bollinger, "symbol", "ts", "bb_middle", "bb_upper", "bb_lower", "bb_bandwidth", "bb_percent_b",
)
on_bars("keltner", q(f"SELECT b.symbol, ts, {r('e1.y', 'kc_middle')}, {r('e1.y + 2 * wa.y', 'kc_upper')}, {r('e1.y - 2 * wa.y', 'kc_lower')} FROM b LEFT JOIN e1 USING (symbol, n) LEFT JOIN wa USING (symbol, n)", sql.TR, sql.wilder("wa", "tr", "t", 10), sql.ema("e1", "b", "close", 20)), ind.add_keltner, "symbol", "ts", "kc_middle", "kc_upper", "kc_lower")
on_bars("donchian", q(f"SELECT {KEYS}, {r('u', 'dc_upper')}, {r('l', 'dc_lower')}, {r('(u + l) / 2', 'dc_middle')} FROM (SELECT *, {roll('max', 'high', 20)} AS u, {roll('min', 'low', 20)} AS l FROM b)"), ind.add_donchian, "symbol", "ts", "dc_upper", "dc_lower", "dc_middle")
on_bars("hist_vol", q(f"SELECT {KEYS}, {r('(' + roll('stddev_pop', 'lr', 20) + ') * sqrt(252) * 100', 'hist_vol')} FROM (SELECT *, ln(close / {lag('close')}) AS lr FROM b)"), ind.add_historical_volatility, "symbol", "ts", "hist_vol")
on_bars("chandelier", q(f"SELECT b.symbol, b.ts, {r('hh - 3 * wa.y', 'chandelier')} FROM (SELECT *, {roll('max', 'high', 22)} AS hh FROM b) b LEFT JOIN wa ON wa.symbol = b.symbol AND wa.n = b.n", sql.TR, sql.wilder("wa", "tr", "t", 22)), ind.add_chandelier, "symbol", "ts", "chandelier")

# --- volume ---
on_bars("volume_ma_relvol", q(f"SELECT {KEYS}, {r('m', 'volume_ma')}, {r('volume / nullif(m, 0)', 'relative_volume')} FROM (SELECT *, {roll('avg', 'volume', 20)} AS m FROM b)"), lambda b: b.withColumns({"volume_ma": ind.sma(20, "volume"), "relative_volume": ind.relative_volume()}), "symbol", "ts", "volume_ma", "relative_volume")
on_bars("obv", q(f"SELECT {KEYS}, cast(sum(s) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS double) + 0.0 AS obv FROM (SELECT *, coalesce(sign(close - {lag('close')}), 0) * volume AS s FROM b)"), ind.add_obv, "symbol", "ts", "obv")
on_bars("accum_dist", q(f"SELECT {KEYS}, {r('sum(s) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)', 'accum_dist')} FROM (SELECT *, CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) END * volume AS s FROM b)"), ind.add_accumulation_distribution, "symbol", "ts", "accum_dist")
_VW = lambda part: f"sum({TP} * volume) OVER (PARTITION BY {part} ORDER BY ts ROWS UNBOUNDED PRECEDING) / nullif(sum(volume) OVER (PARTITION BY {part} ORDER BY ts ROWS UNBOUNDED PRECEDING), 0)"
column("vwap", q(f"SELECT {KEYS}, {r(_VW('symbol, ts::date'), 'vwap')} FROM b", bars=EVENT), ind.vwap, source=src.event_hour)
column("session_vwap", q(f"SELECT {KEYS}, {r(_VW('symbol, (ts + INTERVAL 7 HOUR)::date'), 'session_vwap')} FROM b", bars=EVENT), lambda: ind.vwap(F.to_date(F.col("ts") + F.expr("INTERVAL 7 HOURS"))), source=src.event_hour)
on_bars(
    "anchored_vwap",
    q(f"SELECT {KEYS}, {r('sum(CASE WHEN n >= 50 THEN ' + TP + ' * volume END) OVER o / nullif(sum(CASE WHEN n >= 50 THEN volume END) OVER o, 0)', 'anchored_vwap')} FROM b WINDOW o AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"),
    lambda b: _anchored(b), "symbol", "ts", "anchored_vwap",
)


def _anchored(b: DataFrame) -> DataFrame:
    rows = ind.numbered(b).withColumn("_at", F.max(F.when(F.col("n") == 50, F.col("ts"))).over(of_series()))
    return rows.withColumn("anchored_vwap", ind.anchored_vwap(F.col("_at")))


on_bars("volume_profile_buckets", q(f"SELECT symbol, bucket, {r('price_low')}, {r('price_high')}, volume FROM vp", *sql.PROFILE), ind.volume_buckets, "symbol", "bucket", "price_low", "price_high", "volume", branches=True)
on_bars("volume_profile_poc_va", q(f"SELECT symbol, {r('poc')}, {r('vah')}, {r('val')} FROM poc", *sql.PROFILE), ind.value_area, "symbol", "poc", "vah", "val", branches=True)

# --- structure ---
_FIB = {"pp": "p"} | {k: e for i, x in ((1, 0.382), (2, 0.618), (3, 1.0)) for k, e in ((f"r{i}", f"p + {x}::double * s"), (f"s{i}", f"p - {x}::double * s"))}
_CAM = {"pp": "p"} | {k: e for i, d in ((1, 12), (2, 6), (3, 4), (4, 2)) for k, e in ((f"r{i}", f"c + s * 1.1::double / {d}"), (f"s{i}", f"c - s * 1.1::double / {d}"))}
_CLASSIC = {"pp": "p", "r1": "2 * p - l", "s1": "2 * p - h", "r2": "p + s", "s2": "p - s", "r3": "h + 2 * (p - l)", "s3": "l - 2 * (h - p)"}
for method, named in (("classic", _CLASSIC), ("fibonacci", _FIB), ("camarilla", _CAM)):
    on_bars(f"pivot_{method}", q(sql._pivot(named)), lambda b, method=method: st.daily_pivots(b, method), "symbol", "ts", *named)
_SW = f"sw AS MATERIALIZED (SELECT *, {sql.fractal('high', 5, True)} AS sh, {sql.fractal('low', 5, False)} AS sl FROM b)"
on_bars("swings", q(f"SELECT {KEYS}, sh AS swing_high, sl AS swing_low FROM sw", _SW), st.add_swings, "symbol", "ts", "swing_high", "swing_low")
on_bars(
    "fib_levels",
    q(
        f"SELECT symbol, {r('lo', 'swing_low')}, {r('hi', 'swing_high')}, {', '.join(r(f'hi - {v}::double * (hi - lo)', k) for k, v in st.RETRACEMENTS.items())}, {', '.join(r(f'lo + {v}::double * (hi - lo)', k) for k, v in st.EXTENSIONS.items())} FROM (SELECT symbol, arg_max(low, ts) FILTER (WHERE sl) AS lo, arg_max(high, ts) FILTER (WHERE sh) AS hi FROM sw GROUP BY 1) WHERE hi > lo",
        _SW,
    ),
    st.fibonacci_levels, "symbol", "swing_low", "swing_high", *st.RETRACEMENTS, *st.EXTENSIONS,
)
on_bars("level_clusters", q(f"SELECT symbol, {r('price')}, touches, volume, {r('wick')}, first_seen, last_tested FROM lv", *sql.CLUSTERS), st.swing_clusters, "symbol", "price", "touches", "volume", "wick", "first_seen", "last_tested")
on_bars("level_strength", q(f"SELECT symbol, {r('price')}, {r('strength')} FROM lv", *sql.CLUSTERS), st.swing_clusters, "symbol", "price", "strength")
on_bars("level_supplementary", q(f"SELECT symbol, source, {r('price')}, {r('strength')} FROM sup", *sql.SUPPLEMENT), st.supplementary_levels, "symbol", "source", "price", "strength", branches=True)
on_bars("levels_final", q(f"SELECT symbol, level_type, {r('price')}, {r('strength')}, source, touches, role_flipped FROM lev", *sql.LEVELS), st.price_levels, "symbol", "level_type", "price", "strength", "source", "touches", "role_flipped", branches=True)
on_bars("candles_shape", q(sql._SHAPES, *sql.CANDLES), st.candle_shapes, "symbol", "ts", "pattern")
on_bars("candles_context", q(sql._patterns(), *sql.LEVELS, *sql.CANDLES, *sql._CZ), lambda b: st.candle_patterns(b, st.price_levels(b)), "symbol", "ts", "pattern", "direction", "reliability", branches=True)

# --- validation: gaps, jumps and zero volumes are made from the bars ---
_DIRTY_SQL = """dirty AS MATERIALIZED (SELECT symbol, ts, n, open, high, low, CASE WHEN n % 50 IN (7, 8) OR symbol LIKE '%1' AND n % 90 BETWEEN 20 AND 23 THEN NULL ELSE close END AS close, CASE WHEN n % 37 = 5 THEN 0 ELSE volume END AS volume FROM b)"""


def dirty(b: DataFrame) -> DataFrame:
    n = F.col("n")
    gap = (n % 50).isin(7, 8) | (F.col("symbol").endswith("1") & (n % 90).between(20, 23))
    return ind.numbered(b).withColumns({"close": F.when(~gap, F.col("close")), "volume": F.when(n % 37 == 5, F.lit(0)).otherwise(F.col("volume"))})


_CLEAN = "cl AS MATERIALIZED (SELECT *, open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL AS gap FROM dirty WHERE NOT coalesce(volume = 0, false))"
_RUNS = ["il AS MATERIALIZED (SELECT *, sum(CASE WHEN gap THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS island FROM cl)", f"ru AS MATERIALIZED (SELECT *, CASE WHEN gap THEN count(CASE WHEN gap THEN 1 END) OVER (PARTITION BY symbol, island) ELSE 0 END AS run, min(CASE WHEN gap THEN ts END) OVER (PARTITION BY symbol, island) AS start, abs(close / {lag('close')} - 1) > 0.35 AS jump FROM il)"]
on_bars(
    "validate_report",
    q(
        """SELECT d.symbol, suspended, bars, flags, filled, longest_gap, gap_start, CASE WHEN longest_gap > 2 THEN 'gap' WHEN bars < 200 THEN 'short' ELSE 'ok' END AS status
        FROM (SELECT symbol, count(CASE WHEN volume = 0 THEN 1 END) AS suspended FROM dirty GROUP BY 1) d
        JOIN (SELECT symbol, count(*) AS bars, count(CASE WHEN jump THEN 1 END) AS flags, count(CASE WHEN gap THEN 1 END) AS filled, max(run) AS longest_gap,
          arg_min(start, row(-run, ts)) FILTER (WHERE gap) AS gap_start FROM ru GROUP BY 1) USING (symbol)""",
        _DIRTY_SQL, _CLEAN, *_RUNS,
    ),
    lambda b: rel.validation_report(dirty(b), "swing"), "symbol", "suspended", "bars", "flags", "filled", "longest_gap", "gap_start", "status",
)
on_bars("corporate_actions", q(f"SELECT * FROM (SELECT {KEYS}, {r(f'close / nullif({lag('close')}, 0) - 1', 'change')} FROM cl) WHERE abs(change) > 0.35", _DIRTY_SQL, _CLEAN), lambda b: rel.corporate_actions(dirty(b)), "symbol", "ts", "change")
_FILL = "coalesce(close, lag(close) OVER w, lag(close, 2) OVER w)"
on_bars("gap_fill", q(f"SELECT {KEYS}, {r(_FILL, 'close')}, gap AS filled FROM cl WINDOW w AS (PARTITION BY symbol ORDER BY ts)", _DIRTY_SQL, _CLEAN), lambda b: rel.fill_gaps(rel.drop_suspended(dirty(b))), "symbol", "ts", "close", "filled")

on_bars(
    "validated_bars",
    q(
        f"SELECT {KEYS}, {r(_FILL, 'close')}, filled FROM (SELECT *, gap AS filled FROM cl) WHERE_ WINDOW w AS (PARTITION BY symbol ORDER BY ts)".replace(
            "WHERE_", "WHERE symbol IN (SELECT symbol FROM ru GROUP BY 1 HAVING max(run) <= 2 AND count(*) >= 100)"
        ),
        _DIRTY_SQL, _CLEAN, *_RUNS,
    ),
    lambda b: rel.validated(dirty(b), "day"), "symbol", "ts", "close", "filled",
)


@register(
    "tick_round",
    f"""SELECT p_partkey, {sql._TICK('p')} AS tick, cast({sql._DOWN('p')} AS double) AS down, cast(ceil(p / {sql._TICK('p')}) * {sql._TICK('p')} AS double) AS up, cast({sql._NEAR('p')} AS double) AS nearest
    FROM (SELECT p_partkey, round(p_retailprice * 5, 4) AS p FROM part)""",
)
def tick_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.round(F.col("p_retailprice") * 5, 4).cast("decimal(18,4)")
    rounded = [round_to_tick(p, how).cast("double").alias(how) for how in ("down", "up", "nearest")]
    return src.table(spark, sf_dir, "part").select("p_partkey", tick_size(p).alias("tick"), *rounded)


# --- relational surface ---
@register("instrument_search", "SELECT n_nationkey AS instrument_id, n_name AS symbol, r_name AS sector FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_name ILIKE '%an%' AND r_name = 'ASIA' ORDER BY 2")
def instrument_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.search(src.nations(spark, sf_dir), "AN", sector="ASIA").orderBy("symbol")


_SUMMARY = """sm AS MATERIALIZED (SELECT n_name AS symbol, r_name AS sector, lp AS last_price, pp AS prev_price, 100 * (lp - pp) / nullif(pp, 0) AS change_pct FROM nation JOIN region ON n_regionkey = r_regionkey
  LEFT JOIN (SELECT symbol, max(CASE WHEN k = 1 THEN close END) AS lp, max(CASE WHEN k = 2 THEN close END) AS pp FROM (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) GROUP BY 1) x ON x.symbol = n_name)"""
_TOLD = f"symbol, sector, {r('last_price')}, {r('change_pct')}"


def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rel.summary(src.nations(spark, sf_dir), src.nation_week(spark, sf_dir))


register("summary_change", q(f"SELECT {_TOLD} FROM sm", _SUMMARY, bars=NATION))(lambda spark, d: told(_summary(spark, d), "symbol", "sector", "last_price", "change_pct"))
_TOP = "SELECT {0} FROM (SELECT * FROM sm WHERE change_pct IS NOT NULL ORDER BY change_pct {1}, symbol LIMIT 5)"
register("top_gainers", q(_TOP.format(_TOLD, "DESC"), _SUMMARY, bars=NATION))(lambda spark, d: told(rel.movers(_summary(spark, d)), "symbol", "sector", "last_price", "change_pct"))
register("top_losers", q(_TOP.format(_TOLD, "ASC"), _SUMMARY, bars=NATION))(lambda spark, d: told(rel.movers(_summary(spark, d), gainers=False), "symbol", "sector", "last_price", "change_pct"))
on_bars("ohlcv_range", q(f"SELECT {KEYS}, {PRICES}, volume FROM b WHERE ts BETWEEN '1995-01-02' AND '1996-12-30'"), lambda b: rel.between(b, "1995-01-02", "1996-12-30"), "symbol", "ts", "open", "high", "low", "close", "volume")
on_bars("sufficiency", q("SELECT symbol, count(*) AS available_bars, count(*) >= 60 AS enough FROM b GROUP BY 1"), rel.sufficiency, "symbol", "available_bars", "enough")
on_bars("high_low_252", q(f"SELECT symbol, {r('max(high)', 'high')}, {r('min(low)', 'low')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b) WHERE k <= 252 GROUP BY 1"), lambda b: ind.tail(b, 252).groupBy("symbol").agg(F.max("high").alias("high"), F.min("low").alias("low")), "symbol", "high", "low")
on_bars(
    "sparkline",
    q(f"SELECT symbol, ts, {r('CASE WHEN hi = lo THEN 0.5 ELSE (close - lo) / nullif(hi - lo, 0) END', 'y')} FROM (SELECT *, min(close) OVER (PARTITION BY symbol) AS lo, max(close) OVER (PARTITION BY symbol) AS hi FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b) WHERE k <= 20)".replace("symbol, ts,", "symbol, cast(20 - k AS int) AS i,", 1)),
    lambda b: rel.sparkline(b).select("symbol", F.posexplode("line").alias("i", "y")), "symbol", "i", "y",
)

# --- scores and plans ---
on_bars(
    "trend_score",
    q(
        """SELECT b.symbol, b.ts, cast(CASE WHEN b.close > e1.y THEN 20 ELSE 0 END + CASE WHEN e1.y > e2.y THEN 20 ELSE 0 END + CASE WHEN e2.y > e3.y THEN 20 ELSE 0 END
        + CASE WHEN wx.y > 25 THEN 20 WHEN wx.y > 20 THEN 10 ELSE 0 END + CASE WHEN coalesce(way, 'up') = 'up' THEN 20 ELSE 0 END AS int) AS trend_score
        FROM b JOIN e1 USING (symbol, n) JOIN e2 USING (symbol, n) JOIN e3 USING (symbol, n) LEFT JOIN wx USING (symbol, n) LEFT JOIN sr USING (symbol, n)""",
        *sql.ADX, *[c for c in sql.SUPERTREND if c != sql.TR], sql.ema("e1", "b", "close", 20), sql.ema("e2", "b", "close", 50), sql.ema("e3", "b", "close", 200),
    ),
    rel.trend_score, "symbol", "ts", "trend_score", branches=True,
)
_W = rel.MODES["swing"]
_SCORE = f"({_W['trend']}::double * rsi + {_W['momentum']}::double * (100 - rsi) + {_W['volume']}::double * 50 + {_W['structure']}::double * rsi)"
on_bars(
    "composite_action",
    q(
        f"SELECT {KEYS}, {r('score')}, CASE WHEN score >= 80 THEN 'strong_buy' WHEN score >= 65 THEN 'buy' WHEN score >= 45 THEN 'hold' WHEN score >= 30 THEN 'reduce' ELSE 'sell' END AS action, CASE WHEN score >= 80 OR score < 30 THEN 'high' ELSE 'medium' END AS confidence FROM (SELECT *, {_SCORE} AS score FROM rsi WHERE rsi IS NOT NULL)",
        *sql.RSI,
    ),
    lambda b: _composite(b), "symbol", "ts", "score", "action", "confidence",
)


def _composite(b: DataFrame) -> DataFrame:
    rows = ind.add_rsi(b).filter("rsi IS NOT NULL")
    parts = {"trend": F.col("rsi"), "momentum": 100 - F.col("rsi"), "volume": F.lit(50.0), "structure": F.col("rsi")}
    rows = rows.withColumn("score", rel.composite(parts, "swing"))
    return rows.withColumns({"action": rel.action(F.col("score")), "confidence": rel.confidence(F.col("score"))})


on_bars("stop_take", q(f"SELECT symbol, {r('entry')}, {r('stop')}, {r('tp1')}, {r('tp2')}, {r('tp3')} FROM p5", *sql.PLAN), lambda b: rel.trade_plan(b, "swing"), "symbol", "entry", "stop", "tp1", "tp2", "tp3")
on_bars(
    "position_size",
    q(f"SELECT symbol, {r('round((tp2 - entry) / nullif(risk, 0), 2)', 'rr')}, cast(greatest(0, floor(least(CASE WHEN risk > 0 THEN 1500000::double / (risk * 100) END, 30000000::double / (entry * 100)))) AS bigint) AS lots FROM p5", *sql.PLAN),
    lambda b: rel.trade_plan(b, "swing"), "symbol", "rr", "lots",
)
on_bars(
    "screener_breakout",
    q(
        f"SELECT symbol, ts, {r('close')}, {r('prior_high')}, {r('relvol')}, {r('rsi')} FROM (SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior_high, volume / nullif({roll('avg', 'volume', 20)}, 0) AS relvol FROM rsi) WHERE close > prior_high AND relvol > 1.2 AND rsi BETWEEN 50 AND 75",
        *sql.RSI,
    ),
    rel.breakout, "symbol", "ts", "close", "prior_high", "relvol", "rsi",
)
_CROSS = lambda a, b: f"coalesce(max(CASE WHEN pf {a} ps AND f {b} s THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY ts ROWS 4 PRECEDING), 0) = 1"
on_bars("ma_crosses", q(f"SELECT {KEYS}, {_CROSS('<=', '>')} AS golden_cross, {_CROSS('>=', '<')} AS death_cross FROM (SELECT *, {lag('f')} AS pf, {lag('s')} AS ps FROM ({sql._X20}))"), rel.crosses, "symbol", "ts", "golden_cross", "death_cross")
_POS = "(SELECT s_suppkey, n_name AS symbol, CASE WHEN s_suppkey % 4 = 0 THEN 'short' ELSE 'long' END AS side, 100 * (1 + s_suppkey % 7) AS qty, 1000.0::double + s_suppkey % 50 AS avg_entry FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


@register(
    "portfolio_totals",
    q(
        f"SELECT s_suppkey, {r('mv', 'market_value')}, {r('pnl')}, {r('100 * pnl / nullif(cost, 0)', 'pnl_pct')}, {r('100 * mv / nullif(sum(mv) OVER (), 0)', 'allocation_pct')}, {r('100 * sum(pnl) OVER () / nullif(sum(cost) OVER (), 0)', 'total_pnl_pct')} FROM (SELECT *, CASE WHEN side = 'long' THEN 1 ELSE -1 END * (mv - cost) AS pnl FROM (SELECT s_suppkey, side, qty * last_price AS mv, qty * avg_entry AS cost FROM {_POS} JOIN sm USING (symbol) WHERE last_price IS NOT NULL))",
        _SUMMARY, bars=NATION,
    ),
)
def portfolio_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _summary(spark, sf_dir).filter("last_price IS NOT NULL").select("symbol", F.col("last_price").alias("price"))
    return told(rel.portfolio(_positions(spark, sf_dir), prices), "s_suppkey", "market_value", "pnl", "pnl_pct", "allocation_pct", "total_pnl_pct")


def _positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = src.table(spark, sf_dir, "supplier").join(src.nations(spark, sf_dir), F.col("s_nationkey") == F.col("instrument_id"))
    k = F.col("s_suppkey")
    return held.select("s_suppkey", "symbol", F.when(k % 4 == 0, "short").otherwise("long").alias("side"), (100 * (1 + k % 7)).alias("qty"), (1000.0 + k % 50).alias("avg_entry"))


@register(
    "as_of_price",
    q(f"SELECT o_orderkey, symbol, {r('close')} FROM (SELECT o_orderkey, o_orderdate::timestamp AS ts, n_name AS symbol FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) o ASOF LEFT JOIN bars USING (symbol, ts)", bars=NATION),
)
def as_of_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = src.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = src.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp_ntz").alias("ts"))
    left = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(src.nations(spark, sf_dir), F.col("c_nationkey") == F.col("instrument_id")).select("o_orderkey", "symbol", "ts")
    return told(rng.as_of(left, src.nation_week(spark, sf_dir), by=["symbol"], on="ts", values=["close"]), "o_orderkey", "symbol", "close")


on_bars("backtest_trades", q(f"SELECT symbol, entry_ts, exit_ts, {r('entry')}, {r('exit')}, {r('ret', 'return')}, {r('r', 'r')} FROM td", *sql.BACKTEST), rel.backtest, "symbol", "entry_ts", "exit_ts", "entry", "exit", "return", "r")
_RATIOS = ("win_rate", "profit_factor", "expectancy_r", "total_return", "cagr", "max_drawdown", "sharpe", "sortino")
on_bars(
    "backtest_metrics",
    q(f"SELECT symbol, trades, longest_losing_streak, {', '.join(r(c) for c in _RATIOS)}, {r('cagr / nullif(abs(max_drawdown), 0)', 'calmar')} FROM m4", *sql.BACKTEST, *sql.METRICS),
    lambda b: rel.backtest_metrics(rel.backtest(b)), "symbol", "trades", *_RATIOS, "calmar", "longest_losing_streak",
)
on_bars(
    "signal_listing",
    q(f"SELECT symbol, ts, {r('score')}, action FROM (SELECT *, CASE WHEN score >= 80 THEN 'strong_buy' WHEN score >= 65 THEN 'buy' WHEN score >= 45 THEN 'hold' WHEN score >= 30 THEN 'reduce' ELSE 'sell' END AS action FROM (SELECT *, {_SCORE} AS score FROM rsi WHERE rsi IS NOT NULL)) WHERE action IN ('buy', 'hold') AND score >= 45 AND contains(lower(symbol), '#1') ORDER BY score DESC, symbol, ts LIMIT 20", *sql.RSI),
    lambda b: rel.signals(_composite(b), text="#1", actions=("buy", "hold"), least=45.0, limit=20), "symbol", "ts", "score", "action",
)
on_bars(
    "scale_out",
    q(
        f"SELECT symbol, x.step, {r('x.target', 'target')}, x.lots, {r('x.stop', 'stop_after')} FROM (SELECT symbol, unnest([{{step: 1, target: tp1, lots: a, stop: entry}}, {{step: 2, target: tp2, lots: c, stop: entry}}, {{step: 3, target: tp3, lots: lots - a - c, stop: NULL}}]) AS x FROM (SELECT *, cast(floor(lots * 0.4::double) AS bigint) AS a, cast(floor(lots * 0.3::double) AS bigint) AS c FROM (SELECT *, cast(greatest(0, floor(least(CASE WHEN risk > 0 THEN 1500000::double / (risk * 100) END, 30000000::double / (entry * 100)))) AS bigint) AS lots FROM p5)))",
        *sql.PLAN,
    ),
    lambda b: rel.scale_out(rel.trade_plan(b, "swing")), "symbol", "step", "target", "lots", "stop_after",
)


@register(
    "journal_stats",
    q(
        f"SELECT symbol, count(*) AS trades, {r('100 * avg(CASE WHEN pnl > 0 THEN 1.0::double ELSE 0 END)', 'win_rate')}, {r('avg(pnl)', 'mean_pnl')}, {r('sum(pnl)', 'total_pnl')}, {r('avg(g / nullif(abs(avg_entry - stop), 0))', 'mean_r')} FROM (SELECT *, g * qty AS pnl FROM (SELECT symbol, qty, avg_entry, CASE WHEN s_suppkey % 5 = 0 THEN avg_entry ELSE avg_entry * 0.95::double END AS stop, CASE WHEN side = 'long' THEN 1 ELSE -1 END * (last_price - avg_entry) AS g FROM {_POS} JOIN sm USING (symbol) WHERE last_price IS NOT NULL)) GROUP BY 1",
        _SUMMARY, bars=NATION,
    ),
)
def journal_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    prices = _summary(spark, sf_dir).filter("last_price IS NOT NULL").select("symbol", F.col("last_price").alias("exit"))
    stop = F.when(F.col("s_suppkey") % 5 == 0, F.col("avg_entry")).otherwise(F.col("avg_entry") * 0.95)
    return told(rel.journal(_positions(spark, sf_dir).withColumn("stop", stop).join(prices, "symbol")), "symbol", "trades", "win_rate", "mean_pnl", "total_pnl", "mean_r")


on_bars(
    "sector_percentiles",
    q(f"SELECT sector, {r('median(close)', 'median_close')}, {r('quantile_cont(close, 0.25)', 'p25')}, {r('quantile_cont(close, 0.75)', 'p75')} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM bars) WHERE k = 1 GROUP BY 1", bars=NATION),
    lambda b: ind.tail(b, 1).groupBy("sector").agg(F.median("close").alias("median_close"), F.percentile("close", 0.25).alias("p25"), F.percentile("close", 0.75).alias("p75")), "sector", "median_close", "p25", "p75", source=src.nation_week,
)

_WINDOWED = {
    **{f"sma{n}": roll("avg", "close", n) for n in snap.SMA}, "tenkan": _MID(9), "kijun": _MID(26), "wide": _MID(52), "chikou": "lead(close, 26) OVER (PARTITION BY symbol ORDER BY ts)",
    "h": lag("high"), "l": lag("low"), "c": lag("close"), "p": f"({lag('high')} + {lag('low')} + {lag('close')}) / 3", "s": f"{lag('high')} - {lag('low')}",
    "sd": roll("stddev_pop", "close", 20), "dc_upper": roll("max", "high", 20), "dc_lower": roll("min", "low", 20), "vm": roll("avg", "volume", 20),
    "williams_r": f"-100 * (({_HH}) - close) / nullif(({_HH}) - ({_LL}), 0)", "roc": f"100 * (close - {lag('close', 12)}) / nullif({lag('close', 12)}, 0)",
    "lr": f"ln(close / {lag('close')})", "os": f"coalesce(sign(close - {lag('close')}), 0) * volume", "vwap": _VW("symbol, ts::date"),
    "ad": "CASE WHEN high = low THEN 0 ELSE ((close - low) - (high - close)) / (high - low) END * volume", "back": "row_number() OVER (PARTITION BY symbol ORDER BY ts DESC)",
}
_TOTAL = "OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING)"
_SNAPSHOT_SQL = {
    **{c: f"w2.{c}" for c in ("close", *(f"sma{n}" for n in snap.SMA), "tenkan", "kijun", "senkou_a", "senkou_b", "chikou", "dc_upper", "dc_lower", "williams_r", "roc", "vwap", "hist_vol", "obv", "accum_dist")},
    **{f"ema{n}": f"a{n}.y" for n in snap.EMA}, **{k: f"w2.{k}" for k in _CLASSIC}, "dc_middle": "(w2.dc_upper + w2.dc_lower) / 2", "volume_ma": "w2.vm", "stoch_rsi_k": "t3.k", "stoch_rsi_d": "t3.dd",
    "atr_percent": "100 * wr.y / nullif(w2.close, 0)", "bb_middle": "w2.sma20", "bb_bandwidth": "100 * 4 * w2.sd / nullif(w2.sma20, 0)", "kc_middle": "a20.y", "kc_upper": "a20.y + 2 * wa.y", "kc_lower": "a20.y - 2 * wa.y",
    **{c: f"poc.{c}" for c in ("poc", "vah", "val")}, **{k: f"fb.hi - {v}::double * (fb.hi - fb.lo)" for k, v in st.RETRACEMENTS.items()}, **{k: f"fb.lo + {v}::double * (fb.hi - fb.lo)" for k, v in st.EXTENSIONS.items()},
    "macd": "md.macd", "signal": "e3.y", "histogram": "md.macd - e3.y",
    "rsi": "rsi.rsi", "stoch_k": "s3.k", "stoch_d": "s3.dd", "cci": "cc.cci", "mfi": "CASE WHEN m2.loss = 0 THEN 100 ELSE 100 - 100 / (1 + m2.gain / m2.loss) END", "atr": "wr.y",
    "bb_upper": "w2.sma20 + 2 * w2.sd", "bb_lower": "w2.sma20 - 2 * w2.sd", "bb_percent_b": "(w2.close - (w2.sma20 - 2 * w2.sd)) / nullif((w2.sma20 + 2 * w2.sd) - (w2.sma20 - 2 * w2.sd), 0)",
    "relative_volume": "w2.volume / nullif(w2.vm, 0)", "psar": "pr.sar", "supertrend": "CASE WHEN sr.way = 'up' THEN sr.l ELSE sr.u END", "adx": "wx.y", "plus_di": "di.plus_di", "minus_di": "di.minus_di",
}
_CC = [
    f"tm AS MATERIALIZED (SELECT symbol, ts, n, {TP} AS tp, avg({TP}) OVER (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING) AS m FROM b)",
    "cc AS MATERIALIZED (SELECT t.symbol, t.n, CASE WHEN count(u.tp) = 20 THEN (t.tp - t.m) / nullif(0.015 * avg(abs(u.tp - t.m)), 0) END AS cci FROM tm t JOIN tm u ON u.symbol = t.symbol AND u.n BETWEEN t.n - 19 AND t.n GROUP BY t.symbol, t.n, t.tp, t.m)",
]
on_bars(
    "snapshot_latest",
    q(
        f"""SELECT w2.symbol, w2.ts, {', '.join(r(e, k) for k, e in _SNAPSHOT_SQL.items())}, coalesce(sr.way, 'up') AS direction, cast(NULL AS varchar) AS divergence FROM w2
        {' '.join(f'LEFT JOIN {t} ON {t}.symbol = w2.symbol AND {t}.n = w2.n' for t in (*(f'a{n}' for n in snap.EMA), 'md', 'e3', 'rsi', 's3', 't3', 'cc', 'm2', 'wr', 'wa', 'pr', 'sr', 'wx', 'di'))}
        LEFT JOIN poc ON poc.symbol = w2.symbol LEFT JOIN fb ON fb.symbol = w2.symbol WHERE w2.back = 1""",
        f"w1 AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {k}' for k, e in _WINDOWED.items())} FROM b)",
        f"""w2 AS MATERIALIZED (SELECT *, ({roll('stddev_pop', 'lr', 20)}) * sqrt(252) * 100 AS hist_vol, sum(os) {_TOTAL} AS obv, sum(ad) {_TOTAL} AS accum_dist,
          {lag('(tenkan + kijun) / 2', 26)} AS senkou_a, {lag('wide', 26)} AS senkou_b,
          {', '.join(f'{e} AS {k}' for k, e in _CLASSIC.items())} FROM w1)""",
        *[sql.ema(f"a{n}", "b", "close", n) for n in snap.EMA],
        sql.ema("e1", "b", "close", 12), sql.ema("e2", "b", "close", 26), "md AS MATERIALIZED (SELECT b.*, e1.y - e2.y AS macd FROM b JOIN e1 USING (symbol, n) JOIN e2 USING (symbol, n))", sql.ema("e3", "md", "macd", 9),
        *sql.RSI, *sql._stochastic("close", "high", "low", "b"), *sql._stochastic("rsi", "rsi", "rsi", "rsi", "t"), *_CC, *_MF, *sql.ADX, sql.wilder("wr", "tr", "t", 14), *[c for c in sql.SUPERTREND if c != sql.TR], sql._PSAR, *sql.PROFILE, _SW,
        "fb AS MATERIALIZED (SELECT * FROM (SELECT symbol, arg_max(low, ts) FILTER (WHERE sl) AS lo, arg_max(high, ts) FILTER (WHERE sh) AS hi FROM sw GROUP BY 1) WHERE hi > lo)",
    ),
    lambda b: snap.snapshot(b).select("symbol", "ts", "close", *[f"{group}.*" for group in snap.FIELDS]), "symbol", "ts", "close", *[c for fields in snap.FIELDS.values() for c in fields],
)

# --- recurrences over missing prices, and two timeframes in one table ---
_GAPPY_STEPS = (rec.ema("ema8", "close", 8), rec.ema("ema21", "close", 21), rec.macd(12, 26, 9), rec.rsi("rsi", 14), rec.atr("atr", 14), rec.adx(14), rec.supertrend(10, 3.0))


def gappy(b: DataFrame) -> DataFrame:
    n, symbol = F.col("n"), F.col("symbol")
    gone = (n % 97).isin(8, 40) | (symbol.endswith("2") & (n <= 2)) | (symbol.endswith("3") & (n > 60) & (n < 64))
    return ind.numbered(b).withColumns({c: F.when(~gone, F.col(c)) for c in ("open", "high", "low", "close")})


on_bars(
    "recurrences_over_gaps",
    q(
        f"""SELECT b.symbol, b.ts, {r('g8.y', 'ema8')}, {r('g21.y', 'ema21')}, {r('md.macd', 'macd')}, {r('e3.y', 'signal')}, {r('md.macd - e3.y', 'histogram')}, {r('rsi.rsi', 'rsi')}, {r('wr.y', 'atr')},
        {r('wx.y', 'adx')}, {r('plus_di')}, {r('minus_di')}, {_ST_LINE}, coalesce(way, 'up') AS direction FROM b
        {' '.join(f'LEFT JOIN {t} ON {t}.symbol = b.symbol AND {t}.n = b.n' for t in ('g8', 'g21', 'md', 'e3', 'rsi', 'wr', 'wx', 'di', 'sr'))}""",
        sql.ema("g8", "b", "close", 8), sql.ema("g21", "b", "close", 21), sql.ema("e1", "b", "close", 12), sql.ema("e2", "b", "close", 26),
        "md AS MATERIALIZED (SELECT b.*, e1.y - e2.y AS macd FROM b JOIN e1 USING (symbol, n) JOIN e2 USING (symbol, n))", sql.ema("e3", "md", "macd", 9),
        *sql.RSI, *sql.ADX, sql.wilder("wr", "tr", "t", 14), *[c for c in sql.SUPERTREND if c != sql.TR], bars=sql.GAPPY,
    ),
    lambda b: rec.fold(gappy(b), *_GAPPY_STEPS), "symbol", "ts", "ema8", "ema21", "macd", "signal", "histogram", "rsi", "atr", "adx", "plus_di", "minus_di", "supertrend", "direction",
)


# --- every indicator over bars with prices of 0, missing bars and volumes of 0 ---
def rough(b: DataFrame) -> DataFrame:
    n = F.col("n")
    rows = ind.numbered(b).withColumns({c: F.when((n % 53).isin(7, 8), 0.0).otherwise(F.col(c)) for c in ("close", "low")})
    rows = rows.withColumns({c: F.when(n % 61 != 9, F.col(c)) for c in ("open", "high", "low", "close")})
    return rows.withColumn("volume", F.when((n % 37 == 5) | (n % 200).between(60, 85), F.lit(0)).otherwise(F.col("volume")))


_LR = f"close / nullif({lag('close')}, 0)"
_ROUGH_MADE = {
    **{k: _WINDOWED[k] for k in ("sma20", "sd", "dc_upper", "dc_lower", "vm", "williams_r", "roc", "os", "ad", "vwap", "tenkan", "kijun")}, "lr": f"CASE WHEN {_LR} > 0 THEN ln({_LR}) END",
}
_ROUGH = {
    "sma20": "w1.sma20", "bb_bandwidth": "100 * 4 * w1.sd / nullif(w1.sma20, 0)", "bb_percent_b": "(w1.close - (w1.sma20 - 2 * w1.sd)) / nullif(4 * w1.sd, 0)", "dc_upper": "w1.dc_upper", "dc_lower": "w1.dc_lower", "williams_r": "w1.williams_r", "roc": "w1.roc",
    "relative_volume": "w1.volume / nullif(w1.vm, 0)", "hist_vol": f"({roll('stddev_pop', 'w1.lr', 20, 'w1.symbol', 'w1.ts')}) * sqrt(252) * 100", "obv": f"sum(w1.os) OVER (PARTITION BY w1.symbol ORDER BY w1.ts ROWS UNBOUNDED PRECEDING)", "accum_dist": "sum(w1.ad) OVER (PARTITION BY w1.symbol ORDER BY w1.ts ROWS UNBOUNDED PRECEDING)",
    "vwap": "w1.vwap", "tenkan": "w1.tenkan", "kijun": "w1.kijun", "ema21": "g21.y", "macd": "md.macd", "rsi": "rsi.rsi", "atr_percent": "100 * wr.y / nullif(w1.close, 0)", "adx": "wx.y", "stoch_k": "s3.k", "mfi": "CASE WHEN m2.loss = 0 THEN 100 ELSE 100 - 100 / (1 + m2.gain / m2.loss) END", "cci": "cc.cci",
}


def _rough_indicators(b: DataFrame) -> DataFrame:
    rows = rec.fold(rough(b), rec.ema("ema21", "close", 21), rec.macd(12, 26, 9), rec.rsi("rsi", 14), rec.atr("atr", 14), rec.adx(14))
    rows = rows.withColumns({"sma20": ind.sma(20), "williams_r": ind.williams_r(), "roc": ind.roc(), "relative_volume": ind.relative_volume(), "vwap": ind.vwap(), "atr_percent": 100 * F.try_divide("atr", "close")})
    for add in (ind.add_bollinger, ind.add_donchian, ind.add_historical_volatility, ind.add_obv, ind.add_accumulation_distribution, ind.add_ichimoku, ind.add_stochastic, ind.add_mfi, ind.add_cci):
        rows = add(rows)
    return rows


on_bars(
    "indicators_over_zeros",
    q(
        f"""SELECT w1.symbol, w1.ts, {', '.join(r(e, k) for k, e in _ROUGH.items())} FROM w1 {' '.join(f'LEFT JOIN {t} ON {t}.symbol = w1.symbol AND {t}.n = w1.n' for t in ('g21', 'md', 'rsi', 'wr', 'wx', 's3', 'm2', 'cc'))}""",
        f"w1 AS MATERIALIZED (SELECT *, {', '.join(f'{e} AS {k}' for k, e in _ROUGH_MADE.items())} FROM b)", sql.ema("g21", "b", "close", 21), sql.ema("e1", "b", "close", 12), sql.ema("e2", "b", "close", 26),
        "md AS MATERIALIZED (SELECT b.*, e1.y - e2.y AS macd FROM b JOIN e1 USING (symbol, n) JOIN e2 USING (symbol, n))", *sql.RSI, *sql.ADX, sql.wilder("wr", "tr", "t", 14), *sql._stochastic("close", "high", "low", "b"), *_MF, *_CC, bars=sql.ROUGH,
    ),
    _rough_indicators, "symbol", "ts", *_ROUGH,
)
on_bars("snapshot_over_zeros", q("SELECT symbol, max(ts) AS ts FROM b GROUP BY 1", bars=sql.ROUGH), lambda b: snap.snapshot(rough(b).drop("n")).select("symbol", "ts"), "symbol", "ts")


def _two_timeframes(b: DataFrame) -> DataFrame:
    weeks, months = b.withColumn("timeframe", F.lit("1w")), src.resample(b, "month").withColumn("timeframe", F.lit("1mo"))
    shared = ["symbol", "timeframe", "ts", "open", "high", "low", "close", "volume"]
    with keyed_by("symbol", "timeframe"):
        rows = weeks.select(*shared).unionByName(months.select(*shared)).withColumn("sma20", ind.sma(20))
        return rec.fold(rows, rec.ema("ema21", "close", 21), rec.rsi("rsi", 14)).withColumn("symbol", F.concat_ws("/", "symbol", "timeframe"))


on_bars(
    "two_timeframes",
    q(f"SELECT b.symbol, b.ts, {r(roll('avg', 'rsi.close', 20, 'b.symbol', 'b.ts'), 'sma20')}, {r('g21.y', 'ema21')}, {r('rsi.rsi', 'rsi')} FROM b JOIN rsi USING (symbol, n) JOIN g21 USING (symbol, n)", *sql.RSI, sql.ema("g21", "b", "close", 21), bars=sql.TWO),
    _two_timeframes, "symbol", "ts", "sma20", "ema21", "rsi", branches=True,
)


# --- quotes, calendar, fundamentals, presets, zones, chart patterns ---
on_bars(
    "quotes",
    q(f"SELECT symbol, ts, {r('close', 'last_price')}, {r('close - pc', 'change')}, {r('CASE WHEN pc = 0 THEN 0 ELSE 100 * (close - pc) / nullif(pc, 0) END', 'change_pct')}, volume FROM (SELECT *, {lag('close')} AS pc, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b) WHERE k = 1"),
    scr.quotes, "symbol", "ts", "last_price", "change", "change_pct", "volume",
)


@register(
    "session_ticks",
    "SELECT event_type, count(*) AS ticks, count(CASE WHEN isodow(ts) <= 5 AND (hour(ts) * 60 + minute(ts) >= 540 AND hour(ts) * 60 + minute(ts) < 690 OR hour(ts) * 60 + minute(ts) >= 810 AND hour(ts) * 60 + minute(ts) < 900) THEN 1 END) AS in_session FROM events GROUP BY 1",
)
def session_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src.table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("ticks"), F.count(F.when(scr.in_session(F.col("ts")), 1)).alias("in_session"))


@register(
    "statement_rows",
    f"SELECT 'y' || year(o_orderdate) AS period, {', '.join(r(f'sum(o_totalprice) FILTER (WHERE o_orderstatus = {chr(39)}{s}{chr(39)})', s) for s in 'FOP')} FROM orders GROUP BY 1",
)
def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = src.table(spark, sf_dir, "orders").select("o_orderstatus", "o_totalprice", F.concat(F.lit("y"), F.year("o_orderdate")).alias("y"))
    years = [row["y"] for row in orders.select("y").distinct().orderBy("y").collect()]  # a row a year
    wide = orders.groupBy("o_orderstatus").pivot("y", years).agg(F.sum("o_totalprice"))
    return told(scr.statement_rows(wide, label="o_orderstatus", periods=years, labels=list("FOP")), "period", "F", "O", "P")


@register(
    "fundamental_growth",
    f"""WITH qs AS (SELECT n_name AS symbol, r_name AS sector, date_trunc('quarter', o_orderdate)::timestamp AS period, sum(o_totalprice) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
    g AS (SELECT *, 100 * (revenue / nullif(lag(revenue, 4) OVER (PARTITION BY symbol ORDER BY period), 0) - 1) AS growth FROM qs)
    SELECT symbol, sector, period, {r('revenue')}, {r('growth')}, {r('percent_rank() OVER (PARTITION BY sector, period ORDER BY growth NULLS FIRST)', 'sector_rank')} FROM g""",
)
def fundamental_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = src.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = src.table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice", F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz").alias("period"))
    met = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(src.nations(spark, sf_dir), F.col("c_nationkey") == F.col("instrument_id"))
    quarters = met.groupBy("symbol", "sector", "period").agg(F.sum("o_totalprice").alias("revenue"))
    return told(scr.year_growth(quarters), "symbol", "sector", "period", "revenue", "growth", "sector_rank")


_PRESETS = {
    "momentum_breakout": "close > prior_high AND relvol > 1.2 AND rsi BETWEEN 55 AND 70 AND adx > 25",
    "pullback": "e2 > e3 AND low <= e1 AND high >= e1 AND rsi BETWEEN 40 AND 55 AND volume < pv",
    "oversold": "rsi < 30",
    "high_volume": "relvol > 1.5 AND close > open",
}
on_bars(
    "screener_presets",
    q(
        " UNION ALL ".join(f"SELECT symbol, ts, '{k}' AS preset FROM pz WHERE {v}" for k, v in _PRESETS.items()),
        *sql.ADX, *sql.RSI, sql.ema("x1", "b", "close", 20), sql.ema("x2", "b", "close", 50), sql.ema("x3", "b", "close", 200),
        f"""pz AS MATERIALIZED (SELECT rsi.*, wx.y AS adx, x1.y AS e1, x2.y AS e2, x3.y AS e3, max(high) OVER (PARTITION BY rsi.symbol ORDER BY ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS prior_high,
          volume / nullif({roll('avg', 'volume', 20, 'rsi.symbol')}, 0) AS relvol, lag(volume) OVER (PARTITION BY rsi.symbol ORDER BY ts) AS pv
          FROM rsi JOIN x1 USING (symbol, n) JOIN x2 USING (symbol, n) JOIN x3 USING (symbol, n) LEFT JOIN wx USING (symbol, n))""",
    ),
    scr.screen, "symbol", "ts", "preset",
)
_UP = lambda p: f"(ceil(({p}) / {sql._TICK(p)}) * {sql._TICK(p)})"
on_bars(
    "entry_zone",
    q(
        f"SELECT symbol, {r('zl', 'zone_low')}, {r('zh', 'zone_high')}, {r('(zl + zh) / 2', 'reference')}, {r(_UP('round(greatest(zh, high) + 1, 4)'), 'trigger')} FROM z3",
        sql.TR,
        f"z1 AS MATERIALIZED (SELECT *, {roll('avg', 't', 14)} AS a, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM tr)",
        f"z2 AS MATERIALIZED (SELECT *, CASE WHEN close - a > 0 THEN {sql._DOWN('round(close - a, 4)')} END::double AS zl FROM z1 WHERE k = 1)",
        f"z3 AS MATERIALIZED (SELECT *, {_UP('round(zl + 0.4::double * a, 4)')}::double AS zh FROM z2)",
    ),
    scr.entry_zone, "symbol", "zone_low", "zone_high", "reference", "trigger",
)
on_bars(
    "double_extremes",
    q(
        f"""SELECT symbol, ts, CASE WHEN kind = 'high' THEN 'double_top' ELSE 'double_bottom' END AS pattern, {r('p1', 'breakout_level')}, {r('2 * p1 - (price + p2) / 2', 'measured_target')} FROM (
          SELECT *, lag(price) OVER w AS p1, lag(price, 2) OVER w AS p2, lag(kind) OVER w AS k1, lag(kind, 2) OVER w AS k2 FROM (SELECT symbol, ts, high AS price, 'high' AS kind FROM sw WHERE sh UNION ALL SELECT symbol, ts, low, 'low' FROM sw WHERE sl) WINDOW w AS (PARTITION BY symbol ORDER BY ts, kind))
        WHERE kind = k2 AND kind <> k1 AND abs(price / nullif(p2, 0) - 1) <= 0.01""",
        _SW,
    ),
    scr.double_extremes, "symbol", "ts", "pattern", "breakout_level", "measured_target",
)
on_bars("holdout", q("SELECT symbol, held_out, count(*) AS bars FROM (SELECT *, percent_rank() OVER (PARTITION BY symbol ORDER BY ts) >= 0.8 AS held_out FROM b) GROUP BY 1, 2"), lambda b: scr.holdout(b).groupBy("symbol", "held_out").agg(F.count("*").alias("bars")), "symbol", "held_out", "bars")
on_bars(
    "gated_action",
    q(
        """SELECT symbol, CASE WHEN round((tp2 - entry) / nullif(risk, 0), 2) >= 2.0 AND mv >= 500000 AND nb >= 200 THEN 'buy' ELSE 'hold' END AS action FROM p5
        JOIN (SELECT symbol, avg(value) FILTER (WHERE k <= 20) AS mv, count(*) AS nb FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS k FROM b) GROUP BY 1) USING (symbol)""",
        *sql.PLAN,
    ),
    lambda b: _gated(b), "symbol", "action",
)


def _gated(b: DataFrame) -> DataFrame:
    last = ind.tail(b.withColumns({"traded": scr.mean_value(), "bars": F.count("*").over(of_series()), "suspended": F.coalesce(F.col("volume") == 0, F.lit(False))}), 1)
    met = rel.trade_plan(b, "swing").join(last.select("symbol", "traded", "bars", "suspended"), "symbol")
    return met.withColumn("action", scr.gated(F.lit("buy"), rr=F.col("rr"), least_rr=2.0, traded=F.col("traded"), least_traded=500_000.0, bars=F.col("bars"), least_bars=200, suspended=F.col("suspended")))

from tickloom.plans import strategy, streams  # noqa: E402, F401  register their queries
