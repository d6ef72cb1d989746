"""SQL twins of the queries, for a second engine: independent recursions and window SQL over the same tables."""

from __future__ import annotations

_ORDER = "row(l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey)"
_LINE = f"""arg_min(l_extendedprice / l_quantity, {_ORDER}) AS open, max(l_extendedprice / l_quantity) AS high,
  min(l_extendedprice / l_quantity) AS low, arg_max(l_extendedprice / l_quantity, {_ORDER}) AS close,
  cast(sum(l_quantity) AS bigint) AS volume, sum(l_extendedprice) AS value, count(*) AS frequency"""
BRAND = f"""bars AS MATERIALIZED (SELECT p_brand AS symbol, date_trunc('week', l_shipdate)::timestamp AS ts, {_LINE}
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2)"""
NATION = f"""bars AS MATERIALIZED (SELECT n_name AS symbol, r_name AS sector, date_trunc('week', l_shipdate)::timestamp AS ts, {_LINE}
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)"""
EVENT = """bars AS MATERIALIZED (SELECT event_type AS symbol, date_trunc('hour', ts)::timestamp AS ts, arg_min(value, ts) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, ts) AS close, count(*) AS volume, sum(value) AS value, count(*) AS frequency FROM events GROUP BY 1, 2)"""
#: The same bars with all prices missing now and then.
GAPPY = BRAND.replace("bars AS", "raw AS", 1) + """, bars AS MATERIALIZED (SELECT symbol, ts, CASE WHEN NOT gone THEN open END AS open, CASE WHEN NOT gone THEN high END AS high,
  CASE WHEN NOT gone THEN low END AS low, CASE WHEN NOT gone THEN close END AS close, volume FROM (SELECT *, k % 97 IN (8, 40) OR symbol LIKE '%2' AND k <= 2 OR symbol LIKE '%3' AND k > 60 AND k < 64 AS gone
  FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM raw)))"""
#: The same bars with prices of 0, missing ones and volumes of 0.
ROUGH = BRAND.replace("bars AS", "raw AS", 1) + """, bars AS MATERIALIZED (SELECT symbol, ts, CASE WHEN k % 61 <> 9 THEN open END AS open, CASE WHEN k % 61 <> 9 THEN high END AS high,
  CASE WHEN k % 61 <> 9 THEN (CASE WHEN k % 53 IN (7, 8) THEN 0 ELSE low END) END AS low, CASE WHEN k % 61 <> 9 THEN (CASE WHEN k % 53 IN (7, 8) THEN 0 ELSE close END) END AS close,
  CASE WHEN k % 37 = 5 OR k % 200 BETWEEN 60 AND 85 THEN 0 ELSE volume END AS volume FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS k FROM raw))"""
#: Two timeframes of each brand, the timeframe in the name of the series.
TWO = BRAND.replace("bars AS", "raw AS", 1) + """, bars AS MATERIALIZED (SELECT symbol || '/1w' AS symbol, ts, open, high, low, close, volume FROM raw UNION ALL
  SELECT symbol || '/1mo', date_trunc('month', ts)::timestamp AS t, arg_min(open, ts), max(high), min(low), arg_max(close, ts), cast(sum(volume) AS bigint) FROM raw GROUP BY 1, 2)"""
B = "b AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM bars)"
W = "WINDOW w AS (PARTITION BY symbol ORDER BY ts)"
TP = "((high + low + close) / 3)"


def r(expr: str, name: str | None = None) -> str:
    """Rounded to six places, never -0."""
    return f"round({expr}, 6) + 0.0 AS {name or expr}"


def q(select: str, *ctes: str, bars: str = BRAND) -> str:
    return f"WITH RECURSIVE {', '.join([bars, B, *ctes])} {select}"


def roll(fn: str, x: str, n: int, part: str = "symbol", order: str = "ts") -> str:
    """fn over the last n rows, null until n values are there."""
    over = f"OVER (PARTITION BY {part} ORDER BY {order} ROWS {n - 1} PRECEDING)"
    return f"CASE WHEN count({x}) {over} = {n} THEN {fn}({x}) {over} END"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER (PARTITION BY symbol ORDER BY ts)"


def ema(name: str, source: str, x: str, span: int) -> str:
    """w is what is left of the weight of y; it decays over nulls."""
    a = 2 / (span + 1)
    return f"""{name} AS (SELECT symbol, n, {x} AS y, 1::double AS w FROM {source} WHERE n = 1 UNION ALL
      SELECT s.symbol, s.n, CASE WHEN s.{x} IS NULL THEN e.y WHEN e.y IS NULL THEN s.{x} ELSE (e.w * {1 - a!r} * e.y + {a!r} * s.{x}) / (e.w * {1 - a!r} + {a!r}) END,
        CASE WHEN s.{x} IS NULL THEN e.w * {1 - a!r} ELSE 1 END FROM {name} e JOIN {source} s ON s.symbol = e.symbol AND s.n = e.n + 1)"""


def wilder(name: str, source: str, x: str, n: int) -> str:
    return f"""{name}_s AS MATERIALIZED (SELECT symbol, n, {x} AS x, min(n) FILTER (WHERE {x} IS NOT NULL) OVER (PARTITION BY symbol) AS p,
        avg({x}) OVER (PARTITION BY symbol ORDER BY n ROWS {n - 1} PRECEDING) AS m FROM {source}),
      {name} AS (SELECT symbol, n, m AS y FROM {name}_s WHERE n = p + {n - 1} UNION ALL
      SELECT s.symbol, s.n, (e.y * {n - 1} + s.x) / {n} FROM {name} e JOIN {name}_s s ON s.symbol = e.symbol AND s.n = e.n + 1)"""


TR = f"tr AS MATERIALIZED (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS t FROM b)"
DELTA = f"d AS MATERIALIZED (SELECT *, close - {lag('close')} AS delta FROM b)"
GAIN = "g AS MATERIALIZED (SELECT *, CASE WHEN delta IS NOT NULL THEN greatest(delta, 0) END AS up, CASE WHEN delta IS NOT NULL THEN greatest(-delta, 0) END AS down FROM d)"
RSI = [DELTA, GAIN, wilder("wu", "g", "up", 14), wilder("wd", "g", "down", 14), """rsi AS MATERIALIZED (SELECT b.*, CASE WHEN wd.y = 0 THEN 100 ELSE 100 - 100 / (1 + wu.y / wd.y) END AS rsi
  FROM b LEFT JOIN wu USING (symbol, n) LEFT JOIN wd USING (symbol, n))"""]
ADX = [
    TR,
    f"""dm AS MATERIALIZED (SELECT *, coalesce(CASE WHEN high - {lag('high')} > {lag('low')} - low AND high - {lag('high')} > 0 THEN high - {lag('high')} END, 0) AS p,
      coalesce(CASE WHEN {lag('low')} - low > high - {lag('high')} AND {lag('low')} - low > 0 THEN {lag('low')} - low END, 0) AS m FROM tr)""",
    wilder("wt", "dm", "t", 14), wilder("wp", "dm", "p", 14), wilder("wm", "dm", "m", 14),
    "di AS MATERIALIZED (SELECT symbol, n, 100 * wp.y / nullif(wt.y, 0) AS plus_di, 100 * wm.y / nullif(wt.y, 0) AS minus_di FROM b LEFT JOIN wt USING (symbol, n) LEFT JOIN wp USING (symbol, n) LEFT JOIN wm USING (symbol, n))",
    "dx AS MATERIALIZED (SELECT *, 100 * abs(plus_di - minus_di) / nullif(plus_di + minus_di, 0) AS dx FROM di)",
    wilder("wx", "dx", "dx", 14),
]
SUPERTREND = [
    TR, wilder("wa", "tr", "t", 10),
    f"st AS MATERIALIZED (SELECT b.symbol, b.ts, b.n, close, {lag('close')} AS pc, (high + low) / 2 + 3 * wa.y AS bu, (high + low) / 2 - 3 * wa.y AS bl FROM b LEFT JOIN wa USING (symbol, n))",
    """sr AS (SELECT symbol, n, bu AS u, bl AS l, CASE WHEN close > bl THEN 'up' ELSE 'down' END AS way FROM st WHERE n = 11 UNION ALL
      SELECT symbol, n, u, l, CASE WHEN way = 'up' THEN (CASE WHEN close < l THEN 'down' ELSE 'up' END) ELSE (CASE WHEN close > u THEN 'up' ELSE 'down' END) END
      FROM (SELECT s.symbol, s.n, s.close, e.way, CASE WHEN s.bu < e.u OR s.pc > e.u THEN s.bu ELSE e.u END AS u, CASE WHEN s.bl > e.l OR s.pc < e.l THEN s.bl ELSE e.l END AS l
        FROM sr e JOIN st s ON s.symbol = e.symbol AND s.n = e.n + 1))""",
]
_PSAR = """ps AS MATERIALIZED (SELECT symbol, ts, n, high, low, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(high, 2) OVER w AS h2, lag(low, 2) OVER w AS l2, lead(high) OVER w AS nh FROM b WINDOW w AS (PARTITION BY symbol ORDER BY ts)),
  pr AS (SELECT symbol, n, nh >= high AS up, CASE WHEN nh >= high THEN high ELSE low END AS ep, CASE WHEN nh >= high THEN low ELSE high END AS sar, 0.02::double AS af FROM ps WHERE n = 1 AND nh IS NOT NULL UNION ALL
   SELECT symbol, n, CASE WHEN flip THEN NOT up ELSE up END,
     CASE WHEN flip THEN (CASE WHEN up THEN low ELSE high END) WHEN up THEN greatest(ep, high) ELSE least(ep, low) END, CASE WHEN flip THEN ep ELSE sar END,
     CASE WHEN flip THEN 0.02 WHEN up AND high > ep OR NOT up AND low < ep THEN least(af + 0.02, 0.2) ELSE af END
   FROM (SELECT *, CASE WHEN up THEN low < sar ELSE high > sar END AS flip FROM (
     SELECT s.symbol, s.n, s.high, s.low, e.up, e.ep, e.af, CASE WHEN e.up THEN least(e.sar + e.af * (e.ep - e.sar), s.l1, coalesce(s.l2, s.l1)) ELSE greatest(e.sar + e.af * (e.ep - e.sar), s.h1, coalesce(s.h2, s.h1)) END AS sar
     FROM pr e JOIN ps s ON s.symbol = e.symbol AND s.n = e.n + 1)))"""


def fractal(x: str, n: int, high: bool) -> str:
    over = lambda a, b: f"OVER (PARTITION BY symbol ORDER BY ts ROWS BETWEEN {a} AND {b})"
    fn, cmp, pick = ("max", ">", "greatest") if high else ("min", "<", "least")
    return f"(count({x}) {over(f'{n} PRECEDING', f'{n} FOLLOWING')} = {2 * n + 1} AND {x} {cmp} {pick}({fn}({x}) {over(f'{n} PRECEDING', '1 PRECEDING')}, {fn}({x}) {over('1 FOLLOWING', f'{n} FOLLOWING')}))"


def _stochastic(x: str, high: str, low: str, source: str, name: str = "s") -> list[str]:
    return [
        f"{name}1 AS MATERIALIZED (SELECT *, 100 * ({x} - ({roll('min', low, 14)})) / nullif(({roll('max', high, 14)}) - ({roll('min', low, 14)}), 0) AS raw FROM {source})",
        f"{name}2 AS MATERIALIZED (SELECT *, {roll('avg', 'raw', 3)} AS k FROM {name}1)",
        f"{name}3 AS MATERIALIZED (SELECT *, {roll('avg', 'k', 3)} AS dd FROM {name}2)",
    ]


def _pivot(named: dict[str, str]) -> str:
    inner = f"(SELECT symbol, ts, {lag('high')} AS h, {lag('low')} AS l, {lag('close')} AS c FROM b)"
    return f"SELECT symbol, ts, {', '.join(r(e, k) for k, e in named.items())} FROM (SELECT *, (h + l + c) / 3 AS p, h - l AS s FROM {inner})"


PROFILE = [
    "vt AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM bars) WHERE back <= 250)",
    "vs AS (SELECT symbol, min(low) AS lo, max(high) AS hi FROM vt GROUP BY 1)",
    f"""vb AS MATERIALIZED (SELECT symbol, bucket, lo, hi, cast(sum(volume) AS bigint) AS volume FROM (SELECT symbol, lo, hi, volume,
      CASE WHEN lo = hi THEN 1 ELSE cast(least(50, floor(50 * (({TP.strip()}) - lo) / (hi - lo)) + 1) AS int) END AS bucket FROM vt JOIN vs USING (symbol)) GROUP BY ALL)""",
    "vp AS MATERIALIZED (SELECT symbol, bucket, lo + (bucket - 1) * ((hi - lo) / 50) AS price_low, lo + bucket * ((hi - lo) / 50) AS price_high, volume FROM vb)",
    """va AS MATERIALIZED (SELECT *, row_number() OVER o AS rk, sum(volume) OVER (PARTITION BY symbol ORDER BY volume DESC, bucket ROWS UNBOUNDED PRECEDING) AS cum, sum(volume) OVER (PARTITION BY symbol) AS tot
      FROM vp WINDOW o AS (PARTITION BY symbol ORDER BY volume DESC, bucket))""",
    "poc AS MATERIALIZED (SELECT symbol, max(CASE WHEN rk = 1 THEN (price_low + price_high) / 2 END) AS poc, max(price_high) AS vah, min(price_low) AS val FROM va WHERE rk = 1 OR cum - volume < 0.7 * tot GROUP BY 1)",
]
_S = lambda c: f"CASE WHEN min({c}) OVER p = max({c}) OVER p THEN 50 ELSE 100.0 * ({c} - min({c}) OVER p) / nullif(max({c}) OVER p - min({c}) OVER p, 0) END"
CLUSTERS = [
    "lt AS MATERIALIZED (SELECT * EXCLUDE (back), row_number() OVER (PARTITION BY symbol ORDER BY ts) AS n FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM bars) WHERE back <= 250)",
    f"ltr AS MATERIALIZED (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS t FROM lt)",
    wilder("la", "ltr", "t", 14),
    f"ls AS MATERIALIZED (SELECT lt.*, la.y AS atr, {fractal('high', 5, True)} AS sh, {fractal('low', 5, False)} AS sl FROM lt LEFT JOIN la USING (symbol, n))",
    "lw AS MATERIALIZED (SELECT symbol, max(ts) AS now, coalesce(0.5 * arg_max(atr, ts), 0) AS tol FROM ls GROUP BY 1)",
    """lc AS MATERIALIZED (SELECT symbol, ts, volume, high AS price, high - greatest(open, close) AS wick, 1 AS side FROM ls WHERE sh UNION ALL
      SELECT symbol, ts, volume, low, least(open, close) - low, 0 FROM ls WHERE sl)""",
    "lg AS MATERIALIZED (SELECT *, price - lag(price) OVER (PARTITION BY symbol ORDER BY price, ts, side) AS gap FROM lc JOIN lw USING (symbol))",
    "lk AS MATERIALIZED (SELECT *, sum(CASE WHEN coalesce(gap, 0) > tol THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY price, ts, side ROWS UNBOUNDED PRECEDING) AS cluster FROM lg)",
    "lx AS MATERIALIZED (SELECT symbol, cluster, avg(price) AS price, count(*) AS touches, cast(sum(volume) AS bigint) AS volume, avg(wick) AS wick, min(ts) AS first_seen, max(ts) AS last_tested, max(now) AS now FROM lk GROUP BY 1, 2)",
    f"""lv AS MATERIALIZED (SELECT *, 0.30 * ({_S('touches')}) + 0.25 * ({_S('volume')}) + 0.20 * 100 * exp(-greatest(0, epoch(now) - epoch(last_tested)) / 86400 / 60) + 0.15 * ({_S('wick')}) + 0.10 * 100 AS strength
      FROM lx WINDOW p AS (PARTITION BY symbol))""",
]
_STEP = "(CASE WHEN close < 1000 THEN 50 WHEN close < 10000 THEN 100 ELSE 500 END)"
SUPPLEMENT = [
    *PROFILE, ema("e50", "b", "close", 50), ema("e200", "b", "close", 200),
    "back AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY symbol) AS bars FROM b)",
    """wk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts DESC) AS back FROM (SELECT symbol, date_trunc('week', ts) AS ts, max(high) AS high, min(low) AS low, arg_max(close, ts) AS close FROM b GROUP BY 1, date_trunc('week', ts)))""",
    f"""sup AS MATERIALIZED (
      SELECT symbol, 'ema50' AS source, y AS price, 55.0::double AS strength FROM back JOIN e50 USING (symbol, n) WHERE back = 1 AND bars >= 50
      UNION ALL SELECT symbol, 'ema200', y, 60 FROM back JOIN e200 USING (symbol, n) WHERE back = 1 AND bars >= 200
      UNION ALL SELECT symbol, 'round_number', round_even(close / {_STEP}, 0) * {_STEP} + k * {_STEP}, 50 FROM back, (SELECT unnest([-2, -1, 0, 1, 2]) AS k) WHERE back = 1
      UNION ALL SELECT symbol, 'pivot_daily_' || x.k, x.v, 65 FROM (SELECT symbol, unnest([{{k: 'pp', v: {TP}}}, {{k: 'r1', v: 2 * {TP} - low}}, {{k: 's1', v: 2 * {TP} - high}}]) AS x FROM back WHERE back = 2)
      UNION ALL SELECT symbol, 'pivot_weekly_' || x.k, x.v, 70 FROM (SELECT symbol, unnest([{{k: 'pp', v: {TP}}}, {{k: 'r1', v: 2 * {TP} - low}}, {{k: 's1', v: 2 * {TP} - high}}]) AS x FROM wk WHERE back = 2)
      UNION ALL SELECT symbol, 'high_52w', max(high), 80 FROM back WHERE back <= 252 GROUP BY 1
      UNION ALL SELECT symbol, 'low_52w', min(low), 80 FROM back WHERE back <= 252 GROUP BY 1
      UNION ALL SELECT symbol, 'poc', poc, 75 FROM poc WHERE symbol IN (SELECT symbol FROM back WHERE bars >= 10))""",
]
LEVELS = [
    *CLUSTERS, *SUPPLEMENT,
    "every AS (SELECT symbol, 'swing' AS source, price, strength, touches FROM lv UNION ALL SELECT symbol, source, price, strength, 0 FROM sup)",
    "recent AS MATERIALIZED (SELECT symbol, max(CASE WHEN back = 1 THEN close END) AS close, list(close) FILTER (WHERE back BETWEEN 2 AND 21) AS seen FROM back GROUP BY 1)",
    """fin AS MATERIALIZED (SELECT symbol, CASE WHEN price < close THEN 'support' ELSE 'resistance' END AS level_type, price, strength, source, touches,
      coalesce(list_bool_or(list_transform(seen, lambda c: (c > price) <> (recent.close > price))), false) AS role_flipped FROM every JOIN recent USING (symbol) WHERE strength >= 40)""",
    "lev AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY symbol, level_type ORDER BY strength DESC, price, source) AS rk FROM fin) WHERE rk <= 8)",
]
_C0 = "SELECT *, abs(close - open) AS body, high - low AS span, high - greatest(open, close) AS upper_w, least(open, close) - low AS lower_w FROM b"
CANDLES = [
    f"c0 AS MATERIALIZED ({_C0})",
    """c1 AS MATERIALIZED (SELECT *, lag(open) OVER w AS o1, lag(high) OVER w AS h1, lag(low) OVER w AS l1, lag(close) OVER w AS k1, lag(body) OVER w AS body1,
      lag(open, 2) OVER w AS o2, lag(close, 2) OVER w AS k2, lag(body, 2) OVER w AS body2 FROM c0 WINDOW w AS (PARTITION BY symbol ORDER BY ts))""",
]
SHAPES = {
    "doji": ("any", "span > 0 AND body <= 0.1 * span", 0, 40),
    "marubozu": ("any", "span > 0 AND NOT (span > 0 AND body <= 0.1 * span) AND body >= 0.95 * span", 0, 65),
    "hammer": ("bullish", "body <> 0 AND lower_w >= 2 * body AND upper_w <= 0.3 * body", 0, 60),
    "hanging_man": ("bearish", "body <> 0 AND lower_w >= 2 * body AND upper_w <= 0.3 * body", 0, 55),
    "inverted_hammer": ("bullish", "body <> 0 AND upper_w >= 2 * body AND lower_w <= 0.3 * body", 0, 55),
    "shooting_star": ("bearish", "body <> 0 AND upper_w >= 2 * body AND lower_w <= 0.3 * body", 0, 60),
    "bullish_engulfing": ("bullish", "k1 < o1 AND close > open AND open <= k1 AND close >= o1 AND body > body1", 1, 70),
    "bearish_engulfing": ("bearish", "k1 > o1 AND close < open AND open >= k1 AND close <= o1 AND body > body1", 1, 70),
    "piercing_line": ("bullish", "k1 < o1 AND close > open AND open < l1 AND close > (o1 + k1) / 2 AND close < o1", 1, 65),
    "dark_cloud_cover": ("bearish", "k1 > o1 AND close < open AND open > h1 AND close < (o1 + k1) / 2 AND close > o1", 1, 65),
    "morning_star": ("bullish", "k2 < o2 AND body1 <= 0.5 * body2 AND close > open AND close > (o2 + k2) / 2", 2, 78),
    "evening_star": ("bearish", "k2 > o2 AND body1 <= 0.5 * body2 AND close < open AND close < (o2 + k2) / 2", 2, 78),
    "three_white_soldiers": ("bullish", "k2 > o2 AND k1 > o1 AND close > open AND k1 > k2 AND close > k1 AND o1 > o2 AND o1 < k2 AND open > o1 AND open < k1", 2, 75),
    "three_black_crows": ("bearish", "k2 < o2 AND k1 < o1 AND close < open AND k1 < k2 AND close < k1 AND o1 < o2 AND o1 > k2 AND open < o1 AND open > k1", 2, 75),
}
_SHAPES = " UNION ALL ".join(f"SELECT symbol, ts, '{k}' AS pattern FROM c1 WHERE {c}" for k, (_, c, _, _) in SHAPES.items() if k not in ("hanging_man", "shooting_star"))
_DIR = {"doji": "'neutral'", "marubozu": "CASE WHEN close > open THEN 'bullish' ELSE 'bearish' END"}
_MONO = """cm AS MATERIALIZED (SELECT *,
  coalesce(n > 5 AND lag(close, 1) OVER w < lag(close, 2) OVER w AND lag(close, 2) OVER w < lag(close, 3) OVER w AND lag(close, 3) OVER w < lag(close, 4) OVER w AND lag(close, 4) OVER w < lag(close, 5) OVER w, false) AS mono_down,
  coalesce(n > 5 AND lag(close, 1) OVER w > lag(close, 2) OVER w AND lag(close, 2) OVER w > lag(close, 3) OVER w AND lag(close, 3) OVER w > lag(close, 4) OVER w AND lag(close, 4) OVER w > lag(close, 5) OVER w, false) AS mono_up
  FROM c1 WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def _patterns() -> str:
    parts = []
    for name, (needs, cond, back, score) in SHAPES.items():
        at = lambda k: f"lag_{k}{back}" if back else k  # noqa: B023, E731
        ok = cond if needs == "any" else f"({cond}) AND {at(needs)}"
        if name in ("hanging_man", "shooting_star"):
            ok += f" AND NOT {at('bullish')}"
        parts.append(f"SELECT symbol, ts, '{name}' AS pattern, {_DIR.get(name, repr(needs))} AS direction, {score} AS reliability FROM cz WHERE {ok}")
    return " UNION ALL ".join(parts)


_CZ = [
    _MONO,
    """cy AS MATERIALIZED (SELECT cm.*,
      mono_down OR exists(SELECT 1 FROM lev WHERE lev.symbol = cm.symbol AND level_type = 'support' AND abs(lev.price - cm.low) / cm.low <= 0.01) AS bullish,
      mono_up OR exists(SELECT 1 FROM lev WHERE lev.symbol = cm.symbol AND level_type = 'resistance' AND abs(lev.price - cm.high) / cm.high <= 0.01) AS bearish FROM cm)""",
    """cz AS MATERIALIZED (SELECT *, coalesce(lag(bullish) OVER w, false) AS lag_bullish1, coalesce(lag(bearish) OVER w, false) AS lag_bearish1,
      coalesce(lag(bullish, 2) OVER w, false) AS lag_bullish2, coalesce(lag(bearish, 2) OVER w, false) AS lag_bearish2 FROM cy WINDOW w AS (PARTITION BY symbol ORDER BY ts))""",
]
_TICK = lambda p: f"(CASE WHEN {p} < 200 THEN 1 WHEN {p} < 500 THEN 2 WHEN {p} < 2000 THEN 5 WHEN {p} < 5000 THEN 10 ELSE 25 END)"
_DOWN = lambda p: f"(floor(({p}) / {_TICK(p)}) * {_TICK(p)})"
_NEAR = lambda p: f"(floor(({p}) / {_TICK(p)} + 0.5) * {_TICK(p)})"
PLAN = [
    TR, wilder("wa", "tr", "t", 14),
    """pl AS MATERIALIZED (SELECT b.symbol, b.ts, close, wa.y AS atr, min(low) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS 19 PRECEDING) AS sw, row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts DESC) AS back
      FROM b LEFT JOIN wa ON wa.symbol = b.symbol AND wa.n = b.n)""",
    f"p1 AS MATERIALIZED (SELECT *, {_NEAR('round(close, 4)')}::double AS entry FROM pl WHERE back = 1)",
    "p2 AS MATERIALIZED (SELECT *, round(greatest(sw - 0.5 * atr, entry - 2.0 * atr, entry * (1 - 0.07::double)), 4) AS raw FROM p1)",
    f"p3 AS MATERIALIZED (SELECT *, CASE WHEN raw > 0 THEN {_DOWN('raw')}::double END AS stop FROM p2)",
    "p4 AS MATERIALIZED (SELECT *, entry - stop AS risk FROM p3)",
    f"p5 AS MATERIALIZED (SELECT *, {', '.join(f'{_DOWN(f'round(entry + {k}::double * risk, 4)')}::double AS tp{i}' for i, k in ((1, 1.5), (2, 2.5), (3, 4.0)))} FROM p4)",
]
_X20 = f"SELECT *, {roll('avg', 'close', 20)} AS f, {roll('avg', 'close', 50)} AS s FROM b"
BACKTEST = [
    TR, wilder("wa", "tr", "t", 14), ema("x20", "b", "close", 20),
    f"""xs AS MATERIALIZED (SELECT b.symbol, b.ts, b.n, open, high, low, close > x20.y AND lag(close) OVER (PARTITION BY b.symbol ORDER BY b.n) <= lag(x20.y) OVER (PARTITION BY b.symbol ORDER BY b.n) AS sig,
      close - 2.0::double * wa.y AS st, close + 2.5::double * 2.0::double * wa.y AS tk FROM b JOIN x20 USING (symbol, n) LEFT JOIN wa ON wa.symbol = b.symbol AND wa.n = b.n)""",
    "xl AS MATERIALIZED (SELECT *, lag(sig) OVER w AS ps, lag(st) OVER w AS pt, lag(tk) OVER w AS pk FROM xs WINDOW w AS (PARTITION BY symbol ORDER BY n))",
    # held (since which bar), price, s and t: the position at the bar; got: the price at which the bar ends it
    """bt AS (SELECT symbol, n, cast(NULL AS bigint) AS held, cast(NULL AS double) AS price, cast(NULL AS double) AS s, cast(NULL AS double) AS t, cast(NULL AS double) AS got FROM xl WHERE n = 1 UNION ALL
      SELECT symbol, n, held, price, s, t, CASE WHEN held IS NULL THEN NULL WHEN low <= s THEN least(open, s) WHEN high >= t THEN greatest(open, t) END
      FROM (SELECT x.symbol, x.n, x.open, x.high, x.low, CASE WHEN e.held IS NOT NULL AND e.got IS NULL THEN e.held WHEN x.ps AND x.open > x.pt THEN x.n END AS held,
          CASE WHEN e.held IS NOT NULL AND e.got IS NULL THEN e.price WHEN x.ps AND x.open > x.pt THEN x.open * (1 + 0.001::double) END AS price,
          CASE WHEN e.held IS NOT NULL AND e.got IS NULL THEN e.s WHEN x.ps AND x.open > x.pt THEN x.pt END AS s, CASE WHEN e.held IS NOT NULL AND e.got IS NULL THEN e.t WHEN x.ps AND x.open > x.pt THEN x.pk END AS t
        FROM bt e JOIN xl x ON x.symbol = e.symbol AND x.n = e.n + 1))""",
    """td AS MATERIALIZED (SELECT bt.symbol, i.ts AS entry_ts, o.ts AS exit_ts, price AS entry, got * (1 - 0.001::double) AS exit,
      (got * (1 - 0.001::double) * (1 - 0.0025::double) - price * (1 + 0.0015::double)) / (price * (1 + 0.0015::double)) AS ret, (got * (1 - 0.001::double) - price) / nullif(price - s, 0) AS r
      FROM bt JOIN xl i ON i.symbol = bt.symbol AND i.n = bt.held JOIN xl o ON o.symbol = bt.symbol AND o.n = bt.n WHERE got IS NOT NULL)""",
]
METRICS = [
    "m1 AS MATERIALIZED (SELECT *, exp(sum(ln(1 + ret)) OVER o) AS equity, sum(CASE WHEN ret > 0 THEN 1 ELSE 0 END) OVER o AS island FROM td WINDOW o AS (PARTITION BY symbol ORDER BY entry_ts ROWS UNBOUNDED PRECEDING))",
    """m2 AS MATERIALIZED (SELECT *, equity / greatest(1, max(equity) OVER (PARTITION BY symbol ORDER BY entry_ts ROWS UNBOUNDED PRECEDING)) - 1 AS down,
      sum(CASE WHEN ret > 0 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol, island ORDER BY entry_ts ROWS UNBOUNDED PRECEDING) AS streak FROM m1)""",
    """m3 AS MATERIALIZED (SELECT symbol, count(*) AS trades, 100 * avg(CASE WHEN ret > 0 THEN 1.0::double ELSE 0 END) AS win_rate, sum(ret) FILTER (WHERE ret > 0) / nullif(-sum(ret) FILTER (WHERE ret < 0), 0) AS profit_factor,
      avg(r) AS expectancy_r, exp(sum(ln(1 + ret))) AS growth, (epoch(max(exit_ts)) - epoch(min(entry_ts))) / (365.25::double * 86400) AS years, min(down) AS max_drawdown,
      avg(ret) / nullif(stddev_pop(ret), 0) AS sharpe, avg(ret) / nullif(sqrt(avg(power(least(ret, 0), 2))), 0) AS sortino, cast(max(streak) AS bigint) AS longest_losing_streak FROM m2 GROUP BY 1)""",
    "m4 AS MATERIALIZED (SELECT *, growth - 1 AS total_return, CASE WHEN years > 0 THEN power(growth, 1 / years) - 1 END AS cagr FROM m3)",
]
