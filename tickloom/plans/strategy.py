"""Queries of stored screeners, the signal engine, plans against levels and fundamentals, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators import chart, engine
from tickloom.operators import fundamentals as fun
from tickloom.operators import indicators as ind
from tickloom.operators import leveled
from tickloom.operators import stored
from tickloom.operators import structure as st
from tickloom.operators.series import in_order
from tickloom.plans import oracle as sql
from tickloom.plans.oracle import lag, q, r, roll
from tickloom.plans.registry import on_bars, register, told
from tickloom.sources import bars as src

# --- screeners kept as rows ---
SCREENERS = [
    ("breakout", "close", ">", None, None, "high_20"), ("breakout", "relative_volume", ">", 1.1, None, None), ("breakout", "rsi", "between", 45.0, 80.0, None),
    ("squeezed", "squeeze", "=", 1.0, None, None), ("squeezed", "atr_percent", "<", 120.0, None, None),
    ("macd_turn", "macd_up_bars", "<=", 3.0, None, None), ("macd_turn", "close", ">", 1.01, None, "ema200"),
    ("golden", "golden_cross_bars", "<=", 20.0, None, None), ("golden", "adx", ">", 5.0, None, None),
    ("near_support", "support_pct", "<=", 12.0, None, None), ("near_support", "support_strength", ">=", 50.0, None, None),
    ("room_above", "resistance_pct", ">=", 3.0, None, None), ("room_above", "change_pct", "<", 0.0, None, None),
    ("pullback", "close", "<", 0.95, None, "ema20"), ("pullback", "sma50", ">=", None, None, "sma200"), ("pullback", "mean_value", ">", 0.0, None, None),
]
_CROSSED = lambda a, b: f"lag({a}) OVER o <= lag({b}) OVER o AND {a} > {b}"
_HELD = {
    "breakout": "close > high_20 AND relvol > 1.1 AND rsi BETWEEN 45 AND 80", "squeezed": "squeeze AND atr_percent < 120", "macd_turn": "n - up <= 3 AND close > 1.01::double * ema200",
    "golden": "n - golden <= 20 AND adx > 5", "near_support": "support_pct <= 12 AND support_strength >= 50", "room_above": "resistance_pct >= 3 AND change_pct < 0", "pullback": "close < 0.95::double * ema20 AND sma50 >= sma200 AND mean_value > 0",
}
_SCREENED = [
    *sql.ADX, *sql.RSI, sql.wilder("wn", "tr", "t", 10), *[sql.ema(f"x{n}", "b", "close", n) for n in (20, 200)], sql.ema("e1", "b", "close", 12), sql.ema("e2", "b", "close", 26),
    "md AS MATERIALIZED (SELECT b.*, e1.y - e2.y AS macd FROM b JOIN e1 USING (symbol, n) JOIN e2 USING (symbol, n))", sql.ema("e3", "md", "macd", 9), *sql.LEVELS,
    f"""y1 AS MATERIALIZED (SELECT rsi.*, wx.y AS adx, wt.y AS atr, wn.y AS narrow, x20.y AS ema20, x200.y AS ema200, md.macd, e3.y AS signal, {roll('avg', 'rsi.close', 20, 'rsi.symbol', 'rsi.ts')} AS sma20, {roll('avg', 'rsi.close', 50, 'rsi.symbol', 'rsi.ts')} AS sma50,
      {roll('avg', 'rsi.close', 200, 'rsi.symbol', 'rsi.ts')} AS sma200, {roll('stddev_pop', 'rsi.close', 20, 'rsi.symbol', 'rsi.ts')} AS sd, {roll('avg', 'rsi.value', 20, 'rsi.symbol', 'rsi.ts')} AS mean_value,
      rsi.volume / nullif({roll('avg', 'rsi.volume', 20, 'rsi.symbol', 'rsi.ts')}, 0) AS relvol, max(rsi.high) OVER (PARTITION BY rsi.symbol ORDER BY rsi.ts ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS high_20
      FROM rsi JOIN x20 USING (symbol, n) JOIN x200 USING (symbol, n) JOIN md ON md.symbol = rsi.symbol AND md.n = rsi.n JOIN e3 ON e3.symbol = rsi.symbol AND e3.n = rsi.n LEFT JOIN wx ON wx.symbol = rsi.symbol AND wx.n = rsi.n
      LEFT JOIN wt ON wt.symbol = rsi.symbol AND wt.n = rsi.n LEFT JOIN wn ON wn.symbol = rsi.symbol AND wn.n = rsi.n)""",
    f"""y2 AS MATERIALIZED (SELECT *, 100 * atr / nullif(close, 0) AS atr_percent, 100 * (close - {lag('close')}) / nullif({lag('close')}, 0) AS change_pct,
      sma20 + 2 * sd < ema20 + 1.5::double * narrow AND sma20 - 2 * sd > ema20 - 1.5::double * narrow AS squeeze, {_CROSSED('sma50', 'sma200')} AS gx, {_CROSSED('macd', 'signal')} AS mx, count(*) OVER (PARTITION BY symbol) AS bars
      FROM y1 WINDOW o AS (PARTITION BY symbol ORDER BY ts))""",
    "y3 AS MATERIALIZED (SELECT *, max(CASE WHEN gx THEN n END) OVER o AS golden, max(CASE WHEN mx THEN n END) OVER o AS up FROM y2 WINDOW o AS (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING))",
    """yl AS MATERIALIZED (SELECT lev.symbol, c.n, 100 * (c.close - max(price) FILTER (WHERE level_type = 'support')) / nullif(c.close, 0) AS support_pct, 100 * (min(price) FILTER (WHERE level_type = 'resistance') - c.close) / nullif(c.close, 0) AS resistance_pct,
      arg_max(strength, row(price, strength)) FILTER (WHERE level_type = 'support') AS support_strength FROM lev JOIN y3 c ON c.symbol = lev.symbol AND c.n = c.bars GROUP BY lev.symbol, c.n, c.close)""",
    "y4 AS MATERIALIZED (SELECT * FROM y3 LEFT JOIN yl USING (symbol, n))",
]


@register("stored_screeners", q(" UNION ALL ".join(f"SELECT symbol, ts, '{k}' AS screener FROM y4 WHERE n > bars - 250 AND ({v})" for k, v in _HELD.items()), *_SCREENED))
def stored_screeners(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = src.brand_week(spark, sf_dir).cache()
    return stored.run_screeners(bars, spark.createDataFrame(SCREENERS, stored.CONDITIONS), last=250)


# --- the signal engine ---
_TRADE = lambda p: f"CASE WHEN round({p}, 4) > 0 THEN {sql._DOWN(f'round({p}, 4)')}::double END"
_ENGINE = [
    *sql.ADX, *[c for c in sql.SUPERTREND if c != sql.TR], *sql.RSI, sql.wilder("wz", "tr", "t", 22), *[sql.ema(f"x{n}", "b", "close", n) for n in (20, 50, 200)],
    f"""s1 AS MATERIALIZED (SELECT rsi.*, wt.y AS atr, (CASE WHEN rsi.close > x20.y THEN 20 ELSE 0 END + CASE WHEN x20.y > x50.y THEN 20 ELSE 0 END + CASE WHEN x50.y > x200.y THEN 20 ELSE 0 END
      + CASE WHEN wx.y > 25 THEN 20 WHEN wx.y > 20 THEN 10 ELSE 0 END + CASE WHEN coalesce(way, 'up') = 'up' THEN 20 ELSE 0 END)::double AS trend,
      50 * rsi.volume / nullif({roll('avg', 'rsi.volume', 20, 'rsi.symbol', 'rsi.ts')}, 0) AS relative, {roll('max', 'rsi.high', 20, 'rsi.symbol', 'rsi.ts')} AS hi, {roll('min', 'rsi.low', 20, 'rsi.symbol', 'rsi.ts')} AS lo,
      min(rsi.low) OVER (PARTITION BY rsi.symbol ORDER BY rsi.ts ROWS 39 PRECEDING) AS sw, ({roll('max', 'rsi.high', 22, 'rsi.symbol', 'rsi.ts')}) - 3 * wz.y AS trail
      FROM rsi JOIN x20 USING (symbol, n) JOIN x50 USING (symbol, n) JOIN x200 USING (symbol, n) LEFT JOIN wx USING (symbol, n) LEFT JOIN sr USING (symbol, n) LEFT JOIN wt ON wt.symbol = rsi.symbol AND wt.n = rsi.n LEFT JOIN wz ON wz.symbol = rsi.symbol AND wz.n = rsi.n)""",
    "s2 AS MATERIALIZED (SELECT *, CASE WHEN relative IS NOT NULL THEN least(100, relative) END AS vs, 100 * (close - lo) / nullif(hi - lo, 0) AS structure FROM s1)",
    f"s3 AS MATERIALIZED (SELECT *, 0.30::double * trend + 0.20::double * coalesce(rsi, 0) + 0.15::double * coalesce(vs, 0) + 0.25::double * coalesce(structure, 0) AS score, {_TRADE('(close - 0.25::double * atr)')} AS lim FROM s2)",
    f"s4 AS MATERIALIZED (SELECT *, CASE WHEN lim IS NOT NULL THEN {_TRADE('greatest(sw - 0.5 * atr, lim - 2 * atr, lim * (1 - 0.07::double))')} END AS st FROM s3)",
    f"s5 AS MATERIALIZED (SELECT *, {', '.join(f'{_TRADE(f'(lim + {k}::double * (lim - st))')} AS tp{i}' for i, k in ((1, 1.5), (2, 2.5), (3, 4.0)))} FROM s4)",
]
_SIM = [
    "sx AS MATERIALIZED (SELECT *, lag(score) OVER w AS pscore, lag(lim) OVER w AS plim, lag(st) OVER w AS pst, lag(tp1) OVER w AS p1, lag(tp2) OVER w AS p2, lag(tp3) OVER w AS p3, lag(trail) OVER w AS ptrail FROM s5 WINDOW w AS (PARTITION BY symbol ORDER BY n))",
    # held: the bar of the entry; lft: the share still held after the bar, 0 when it ended the trade; got: what the sold shares have brought
    """sb AS (SELECT symbol, n, cast(NULL AS bigint) AS held, cast(NULL AS double) AS price, cast(NULL AS double) AS safe, cast(NULL AS double) AS a1, cast(NULL AS double) AS a2, cast(NULL AS double) AS a3, cast(NULL AS int) AS hit,
      cast(NULL AS double) AS lft, cast(NULL AS double) AS got, cast(NULL AS double) AS risk FROM sx WHERE n = 1 UNION ALL
      SELECT symbol, n, held, price, safe, a1, a2, a3, hit, CASE WHEN held IS NULL THEN NULL WHEN stopped OR hit = 3 THEN 0 ELSE 1 - CASE WHEN hit >= 1 THEN 0.4::double ELSE 0 END - CASE WHEN hit >= 2 THEN 0.3::double ELSE 0 END END,
        CASE WHEN stopped THEN got0 + lft0 * least(open, safe) * 0.999::double ELSE got0 + CASE WHEN hit0 < 1 AND hit >= 1 THEN 0.4::double * greatest(open, a1) * 0.999::double ELSE 0 END
          + CASE WHEN hit0 < 2 AND hit >= 2 THEN 0.3::double * greatest(open, a2) * 0.999::double ELSE 0 END + CASE WHEN hit0 < 3 AND hit >= 3 THEN 0.3::double * greatest(open, a3) * 0.999::double ELSE 0 END END, risk
      FROM (SELECT *, low <= safe AS stopped, CASE WHEN low > safe AND n > held THEN greatest(hit0, CASE WHEN high >= a3 THEN 3 WHEN high >= a2 THEN 2 WHEN high >= a1 THEN 1 ELSE 0 END) ELSE hit0 END AS hit
        FROM (SELECT symbol, n, open, high, low, CASE WHEN live THEN eheld WHEN fills THEN n END AS held, CASE WHEN live THEN eprice WHEN fills THEN least(open, plim) * 1.001::double END AS price,
          CASE WHEN live THEN (CASE WHEN ehit >= 2 AND ptrail IS NOT NULL THEN greatest(esafe, eprice, ptrail) WHEN ehit >= 1 THEN greatest(esafe, eprice) ELSE esafe END) WHEN fills THEN pst END AS safe,
          CASE WHEN live THEN e1 WHEN fills THEN p1 END AS a1, CASE WHEN live THEN e2 WHEN fills THEN p2 END AS a2, CASE WHEN live THEN e3 WHEN fills THEN p3 END AS a3,
          CASE WHEN live THEN ehit WHEN fills THEN 0 END AS hit0, CASE WHEN live THEN elft WHEN fills THEN 1 END AS lft0, CASE WHEN live THEN egot WHEN fills THEN 0 END AS got0, CASE WHEN live THEN erisk WHEN fills THEN least(open, plim) * 1.001::double - pst END AS risk
          FROM (SELECT x.*, e.held AS eheld, e.price AS eprice, e.safe AS esafe, e.a1 AS e1, e.a2 AS e2, e.a3 AS e3, e.hit AS ehit, e.lft AS elft, e.got AS egot, e.risk AS erisk, coalesce(e.lft > 0, false) AS live,
            coalesce(x.pscore >= 65 AND x.plim > x.pst AND x.low <= x.plim AND x.open > x.pst, false) AS fills FROM sb e JOIN sx x ON x.symbol = e.symbol AND x.n = e.n + 1))))""",
]
#: Calmer bars, on which limits fill and targets are met: closes are means of 20 weeks, the range is 1 % about the body.
_CALM = sql.BRAND.replace("bars AS", "raw AS", 1) + """, bars AS MATERIALIZED (SELECT symbol, ts, open, greatest(open, close) * 1.01::double AS high, least(open, close) * 0.99::double AS low, close, volume
  FROM (SELECT *, coalesce(lag(close) OVER (PARTITION BY symbol ORDER BY ts), close) AS open FROM (SELECT symbol, ts, volume, avg(close) OVER w AS close, count(*) OVER w AS k FROM raw WINDOW w AS (PARTITION BY symbol ORDER BY ts ROWS 19 PRECEDING)) WHERE k = 20))"""


def calm(bars: DataFrame) -> DataFrame:
    mean = bars.select("symbol", "ts", "volume", ind.sma(20).alias("close")).filter("close IS NOT NULL")
    rows = mean.withColumn("open", F.coalesce(F.lag("close").over(in_order()), F.col("close")))
    return rows.withColumns({"high": F.greatest("open", "close") * 1.01, "low": F.least("open", "close") * 0.99})


_FACTORS = ("trend", "momentum", "volume_score", "structure", "score", "limit", "stop", "tp1", "tp2", "tp3")
on_bars(
    "signal_scores",
    q(f"""SELECT symbol, ts, {r('trend')}, {r('rsi', 'momentum')}, {r('vs', 'volume_score')}, {r('structure')}, {r('score')}, {r('lim', '"limit"')}, {r('st', 'stop')}, {r('tp1')}, {r('tp2')}, {r('tp3')} FROM s5""", *_ENGINE),
    lambda b: engine.signals(b, "swing"), "symbol", "ts", *_FACTORS,
)
on_bars(
    "signal_backtest",
    q(
        f"""SELECT sb.symbol, i.ts AS entry_ts, o.ts AS exit_ts, {r('price', 'entry')}, {r('got', 'exit')}, {r('(got * (1 - 0.0025::double) - price * (1 + 0.0015::double)) / (price * (1 + 0.0015::double))', 'return')}, {r('(got - price) / risk', 'r')}, hit AS targets, i.late AS held_out
        FROM sb JOIN (SELECT symbol, n, ts, percent_rank() OVER (PARTITION BY symbol ORDER BY ts) >= 0.8 AS late FROM b) i ON i.symbol = sb.symbol AND i.n = sb.held JOIN b o ON o.symbol = sb.symbol AND o.n = sb.n WHERE lft = 0""",
        *_ENGINE, *_SIM, bars=_CALM,
    ),
    lambda b: engine.signal_backtest(calm(b), "swing"), "symbol", "entry_ts", "exit_ts", "entry", "exit", "return", "r", "targets", "held_out",
)

# --- plans and zones against levels ---
_SW = f"sw AS MATERIALIZED (SELECT *, {sql.fractal('high', 5, True)} AS sh, {sql.fractal('low', 5, False)} AS sl FROM b)"
_FB = "fb AS MATERIALIZED (SELECT * FROM (SELECT symbol, arg_max(low, ts) FILTER (WHERE sl) AS lo, arg_max(high, ts) FILTER (WHERE sh) AS hi FROM sw GROUP BY 1) WHERE hi > lo)"
_NEAR = lambda i: f"(SELECT row(abs(price - raw{i}), price, strength) FROM lev WHERE lev.symbol = v2.symbol AND level_type = 'resistance' AND price > entry ORDER BY abs(price - raw{i}), price, strength LIMIT 1)"
_LAST = [
    *sql.LEVELS, sql.TR, sql.wilder("wv", "tr", "t", 14), _SW, _FB,
    f"""v0 AS MATERIALIZED (SELECT b.*, wv.y AS atr, min(low) OVER (PARTITION BY b.symbol ORDER BY b.ts ROWS 39 PRECEDING) AS swing, {roll('avg', 'volume', 20, 'b.symbol', 'b.ts')} AS usual, row_number() OVER (PARTITION BY b.symbol ORDER BY b.ts DESC) AS back
      FROM b LEFT JOIN wv ON wv.symbol = b.symbol AND wv.n = b.n)""",
    f"v1 AS MATERIALIZED (SELECT v0.*, {sql._NEAR('round(close, 4)')}::double AS entry, fb.lo + 1.618::double * (fb.hi - fb.lo) AS e1618 FROM v0 LEFT JOIN fb USING (symbol) WHERE back = 1)",
]
_PLANNED = [
    *_LAST,
    f"vs1 AS MATERIALIZED (SELECT *, {_TRADE('greatest(swing - 0.5 * atr, entry - 2 * atr, entry * (1 - 0.07::double))')} AS stop FROM v1)",
    "v2 AS MATERIALIZED (SELECT *, entry - stop AS risk, entry + 1.5::double * (entry - stop) AS raw1, entry + 2.5::double * (entry - stop) AS raw2, entry + 4.0::double * (entry - stop) AS raw3 FROM vs1)",
    f"v3 AS MATERIALIZED (SELECT *, {', '.join(f'{_NEAR(i)} AS near{i}' for i in (1, 2, 3))} FROM v2)",
    f"v4 AS MATERIALIZED (SELECT *, {', '.join(f'coalesce(near{i}[1] < 0.5 * atr AND near{i}[3] > 60, false) AS snap{i}' for i in (1, 2, 3))} FROM v3)",
    f"v5 AS MATERIALIZED (SELECT *, {', '.join(f'CASE WHEN snap{i} THEN near{i}[2] - {sql._TICK(f'round(near{i}[2], 4)')} ELSE raw{i} END AS to{i}' for i in (1, 2, 3))} FROM v4)",
    f"v6 AS MATERIALIZED (SELECT *, {', '.join(f'{_TRADE(f'to{i}')} AS tp{i}' for i in (1, 2, 3))} FROM v5)",
    "v7 AS MATERIALIZED (SELECT *, coalesce(e1618 > tp2 AND e1618 < tp3, false) AS capped, CASE WHEN risk > 0 THEN greatest(0, floor(1500000::double / (risk * 100))) END AS l1, greatest(0, floor(30000000::double / (entry * 100))) AS l2, greatest(0, floor(usual * 0.02::double / 100)) AS l3 FROM v6)",
]
on_bars(
    "level_plan",
    q(
        f"""SELECT symbol, {r('entry')}, {r('stop')}, {r('tp1')}, {r('tp2')}, {r(f'CASE WHEN capped THEN {_TRADE("e1618")} ELSE tp3 END', 'tp3')}, {r('round((tp2 - entry) / nullif(risk, 0), 2)', 'rr')}, least(l1, l2, l3)::bigint AS lots,
        CASE WHEN l1 = least(l1, l2, l3) THEN 'risk' WHEN l2 = least(l1, l2, l3) THEN 'exposure' WHEN l3 = least(l1, l2, l3) THEN 'volume' END AS bound, snap1::int + snap2::int + snap3::int AS snapped, capped FROM v7""",
        *_PLANNED,
    ),
    lambda b: leveled.level_plan(b, st.price_levels(b), "swing"), "symbol", "entry", "stop", "tp1", "tp2", "tp3", "rr", "lots", "bound", "snapped", "capped", branches=True,
)
_ZONED = [
    *_LAST, sql.ema("x20", "b", "close", 20), sql.ema("x50", "b", "close", 50),
    "zb AS MATERIALIZED (SELECT v1.*, x20.y AS ema20, x50.y AS ema50, fb.lo, fb.hi FROM v1 JOIN x20 USING (symbol, n) JOIN x50 USING (symbol, n) LEFT JOIN fb USING (symbol))",
    """zc AS MATERIALIZED (SELECT symbol, price, 'support' AS source, strength AS weight FROM (SELECT lev.symbol, price, strength, row_number() OVER (PARTITION BY lev.symbol ORDER BY price DESC, strength DESC) AS k FROM lev JOIN zb USING (symbol) WHERE level_type = 'support' AND price <= close) WHERE k = 1
      UNION ALL SELECT symbol, ema20, 'ema20', 60 FROM zb WHERE ema20 < close AND (close - ema20) / close < 0.1 UNION ALL SELECT symbol, ema50, 'ema50', 60 FROM zb WHERE ema50 < close AND (close - ema50) / close < 0.1
      UNION ALL SELECT symbol, p, k, w FROM (SELECT symbol, close, hi - f.v * (hi - lo) AS p, f.k AS k, 55 + 20 * f.v AS w FROM zb, (SELECT unnest([{k: 'r382', v: 0.382::double}, {k: 'r500', v: 0.5::double}, {k: 'r618', v: 0.618::double}]) AS f)) WHERE p < close)""",
    "zg AS MATERIALIZED (SELECT zc.*, coalesce(price - lag(price) OVER (PARTITION BY symbol ORDER BY price, source, weight) <= 0.5 * atr, false) AS chained, high, atr FROM zc JOIN zb USING (symbol))",
    "zk AS MATERIALIZED (SELECT *, sum(CASE WHEN chained THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY price, source, weight ROWS UNBOUNDED PRECEDING) AS cluster FROM zg)",
    "zm AS MATERIALIZED (SELECT symbol, high, atr, sum(weight) AS weight, sum(price * weight) / sum(weight) AS price, array_to_string(list(source ORDER BY price, source), ',') AS sources FROM zk GROUP BY symbol, high, atr, cluster)",
    "zt AS MATERIALIZED (SELECT * FROM zm QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY weight DESC, price DESC) = 1)",
]
_CEIL = lambda p: f"(ceil(({p}) / {sql._TICK(p)}) * {sql._TICK(p)})"
_ZONED.append(f"zz AS MATERIALIZED (SELECT *, {_TRADE('(price - 0.25 * atr)')} AS zl, {_CEIL('round(price + 0.25 * atr, 4)')}::double AS zh FROM zt)")
on_bars(
    "clustered_zone",
    q(f"SELECT b.symbol, {r('zl', 'zone_low')}, {r('zh', 'zone_high')}, {r(_CEIL(f'round(greatest(zh, zz.high + {sql._TICK("round(zz.high, 4)")}), 4)') , 'trigger')}, {r('weight')}, sources FROM (SELECT DISTINCT symbol FROM b) b LEFT JOIN zz USING (symbol)", *_ZONED),
    lambda b: leveled.clustered_zone(b, st.price_levels(b), "swing").withColumn("sources", F.array_join("sources", ",")), "symbol", "zone_low", "zone_high", "trigger", "weight", "sources", branches=True,
)

# --- fundamentals: quarters made from orders ---
_STATUS = lambda s: f"coalesce(sum(o_totalprice) FILTER (WHERE o_orderstatus = '{s}'), 0)"
_QUARTERS = f"""qs AS MATERIALIZED (SELECT n_name AS symbol, r_name AS sector, date_trunc('quarter', o_orderdate)::timestamp AS period, sum(o_totalprice) AS revenue, {_STATUS('F')} AS f, {_STATUS('O')} AS o, {_STATUS('P')} AS p, count(*) AS orders,
  count(DISTINCT o_custkey) AS customers, avg(o_totalprice) AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3),
st AS MATERIALIZED (SELECT symbol, sector, period, price, revenue, revenue - 0.5::double * f - 0.6::double * o AS gross_profit, 0.3::double * revenue - 0.4::double * p - 0.2::double * f AS net_income, 0.25::double * revenue - 0.3::double * p AS cash_flow, 0.2::double * revenue - 0.5::double * p AS free_cash_flow,
  2 * revenue + f AS assets, revenue + 0.5::double * f - p AS equity, revenue + 0.5::double * f + p AS debt, f + 0.5::double * p AS current_assets, 0.5::double * o + p AS current_liabilities, customers::double AS shares, CASE WHEN orders % 9 = 0 THEN 0 ELSE 0.05::double * revenue END AS dividends FROM qs)"""


def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements by nation and quarter whose figures are mixed from the sums of its orders by status."""
    customers = src.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    orders = src.table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", F.date_trunc("quarter", "o_orderdate").cast("timestamp_ntz").alias("period"))
    met = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(src.nations(spark, sf_dir), F.col("c_nationkey") == F.col("instrument_id"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice"))), F.lit(0.0))
    rows = met.groupBy("symbol", "sector", "period").agg(F.sum("o_totalprice").alias("revenue"), of("F").alias("f"), of("O").alias("o"), of("P").alias("p"), F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.avg("o_totalprice").alias("price"))
    return rows.selectExpr(
        "symbol", "sector", "period", "price", "revenue", "revenue - 0.5D * f - 0.6D * o AS gross_profit", "0.3D * revenue - 0.4D * p - 0.2D * f AS net_income", "0.25D * revenue - 0.3D * p AS cash_flow", "0.2D * revenue - 0.5D * p AS free_cash_flow",
        "2 * revenue + f AS assets", "revenue + 0.5D * f - p AS equity", "revenue + 0.5D * f + p AS debt", "f + 0.5D * p AS current_assets", "0.5D * o + p AS current_liabilities", "CAST(customers AS double) AS shares", "CASE WHEN orders % 9 = 0 THEN 0D ELSE 0.05D * revenue END AS dividends",
    )


_SUM4 = lambda c: f"CASE WHEN count({c}) OVER f = 4 THEN sum({c}) OVER f END AS ttm_{c}"
_YEAR_AGO = lambda c: f"lag({c}, 4) OVER w"
_PCT = lambda c, way: f"CASE WHEN {c} IS NOT NULL THEN CASE WHEN count({c}) OVER (PARTITION BY sector, period) = 1 THEN 50 ELSE 100.0::double * percent_rank() OVER (PARTITION BY sector, period, {c} IS NOT NULL ORDER BY {c} {way}) END END AS p_{c}"
_MEAN = lambda *cs: f"coalesce(({' + '.join(f'coalesce(p_{c}, 0)' for c in cs)}) / nullif({' + '.join(f'(p_{c} IS NOT NULL)::int' for c in cs)}, 0), 0)"
_FUND = [
    f"t1 AS MATERIALIZED (SELECT *, {', '.join(_SUM4(c) for c in ('revenue', 'gross_profit', 'net_income', 'cash_flow', 'free_cash_flow', 'dividends'))} FROM st WINDOW f AS (PARTITION BY symbol ORDER BY period ROWS 3 PRECEDING))",
    "t2 AS MATERIALIZED (SELECT *, ttm_net_income / nullif(assets, 0) AS roa, debt / nullif(assets, 0) AS lev, current_assets / nullif(current_liabilities, 0) AS current_ratio, ttm_gross_profit / nullif(ttm_revenue, 0) AS margin, ttm_revenue / nullif(assets, 0) AS turnover FROM t1)",
    f"""t3 AS MATERIALIZED (SELECT *, coalesce(ttm_net_income > 0, false)::int AS f_income, coalesce(ttm_cash_flow > 0, false)::int AS f_cash_flow, coalesce(roa > {_YEAR_AGO('roa')}, false)::int AS f_return, coalesce(ttm_cash_flow > ttm_net_income, false)::int AS f_accruals,
      coalesce(lev < {_YEAR_AGO('lev')}, false)::int AS f_leverage, coalesce(current_ratio > {_YEAR_AGO('current_ratio')}, false)::int AS f_liquidity, coalesce(shares <= {_YEAR_AGO('shares')}, false)::int AS f_shares, coalesce(margin > {_YEAR_AGO('margin')}, false)::int AS f_margin,
      coalesce(turnover > {_YEAR_AGO('turnover')}, false)::int AS f_turnover, ttm_net_income / nullif(shares, 0) AS eps, equity / nullif(shares, 0) AS bvps, ttm_net_income / nullif(equity, 0) AS roe, ttm_net_income / nullif(ttm_revenue, 0) AS net_margin, debt / nullif(equity, 0) AS der,
      (ttm_dividends / nullif(shares, 0)) / nullif(price, 0) AS dividend_yield, ttm_dividends / nullif(ttm_net_income, 0) AS payout, ttm_revenue / nullif({_YEAR_AGO('ttm_revenue')}, 0) - 1 AS growth,
      sum((net_income > 0)::int) OVER (PARTITION BY symbol ORDER BY period ROWS 11 PRECEDING) AS steady, sum((dividends > 0)::int) OVER (PARTITION BY symbol ORDER BY period ROWS 19 PRECEDING) AS paying,
      greatest(0, least(0.15::double, coalesce(ttm_free_cash_flow / nullif({_YEAR_AGO('ttm_free_cash_flow')}, 0) - 1, 0))) AS g FROM t2 WINDOW w AS (PARTITION BY symbol ORDER BY period))""",
    "t4 AS MATERIALIZED (SELECT *, price / CASE WHEN eps > 0 THEN eps END AS per, price / CASE WHEN bvps > 0 THEN bvps END AS pbv, f_income + f_cash_flow + f_return + f_accruals + f_leverage + f_liquidity + f_shares + f_margin + f_turnover AS f_score FROM t3)",
    f"t5 AS MATERIALIZED (SELECT *, {', '.join(_PCT(c, w) for c, w in (('per', 'DESC'), ('pbv', 'DESC'), ('roe', ''), ('net_margin', ''), ('der', 'DESC'), ('current_ratio', ''), ('growth', '')))}, median(per) OVER (PARTITION BY sector, period) AS mper, median(pbv) OVER (PARTITION BY sector, period) AS mpbv FROM t4)",
    f"""t6 AS MATERIALIZED (SELECT *, {_MEAN('per', 'pbv')} AS valuation_score, {_MEAN('roe', 'net_margin')} AS profitability_score, {_MEAN('der', 'current_ratio')} AS health_score, {_MEAN('growth')} AS growth_score, 50.0::double * f_score / 9 + 50.0::double * coalesce(steady, 0) / 12 AS quality_score,
      CASE WHEN eps * mper > 0 THEN eps * mper END AS value_per, CASE WHEN bvps * mpbv > 0 THEN bvps * mpbv END AS value_pbv, (1 + g) / 1.15::double AS step, CASE WHEN paying = 20 AND ttm_dividends / nullif(shares, 0) > 0 THEN ttm_dividends / shares * 1.03::double / 0.12::double END AS value_ddm FROM t5)""",
    "t7 AS MATERIALIZED (SELECT *, ttm_free_cash_flow * (step + power(step, 2) + power(step, 3) + power(step, 4) + power(step, 5) + power(step, 5) * 1.03::double / 0.12::double) / nullif(shares, 0) AS dcf FROM t6)",
    "t8 AS MATERIALIZED (SELECT *, CASE WHEN dcf > 0 THEN dcf END AS value_dcf FROM t7)",
    "t9 AS MATERIALIZED (SELECT *, list_filter([value_per, value_pbv, value_dcf, value_ddm], lambda x: x IS NOT NULL) AS vals FROM t8)",
    "t10 AS MATERIALIZED (SELECT *, list_aggregate(vals, 'quantile_cont', 0.25) AS fair_low, list_aggregate(vals, 'quantile_cont', 0.75) AS fair_high, len(vals)::int AS methods FROM t9)",
]
_RATIOS = ("eps", "bvps", "per", "pbv", "roe", "net_margin", "der", "current_ratio", "dividend_yield", "payout", "growth")
_TOLD = (*_RATIOS, *(f"{p}_score" for p in fun.WEIGHTS), "value_per", "value_pbv", "value_dcf", "value_ddm", "fair_low", "fair_high")


@register(
    "fundamental_scores",
    f"""WITH {_QUARTERS}, {', '.join(_FUND)} SELECT symbol, sector, period, {', '.join(fun.FLAGS)}, f_score, {', '.join(r(c) for c in _TOLD)}, methods, {r('0.30::double * valuation_score + 0.25::double * profitability_score + 0.20::double * health_score + 0.15::double * growth_score + 0.10::double * quality_score', 'fundamental_score')},
    {r('100 * (fair_low - price) / nullif(fair_low, 0)', 'margin_of_safety')} FROM t10""",
)
def fundamental_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return told(fun.assess(statements(spark, sf_dir)), "symbol", "sector", "period", *fun.FLAGS, "f_score", *_TOLD, "methods", "fundamental_score", "margin_of_safety")

# --- chart patterns ---
_SEQUENCE = [
    f"sq AS MATERIALIZED (SELECT *, {sql.fractal('high', 5, True)} AS sh, {sql.fractal('low', 5, False)} AS sl, lead(ts, 5) OVER (PARTITION BY symbol ORDER BY ts) AS confirmed FROM b)",
    "sv AS MATERIALIZED (SELECT symbol, ts, n, confirmed, 'high' AS kind, high AS price FROM sq WHERE sh UNION ALL SELECT symbol, ts, n, confirmed, 'low', low FROM sq WHERE sl)",
    f"""hs AS MATERIALIZED (SELECT *, p3 + slope * (n - n3) AS edge, p2 - (p3 + slope * (n2 - n3)) AS height FROM (SELECT *, (p1 - p3) / (n1 - n3) AS slope FROM (SELECT *, {', '.join(f'lag({c}, {k}) OVER w AS {a}{k}' for k in (1, 2, 3, 4) for c, a in (('kind', 'k'), ('price', 'p'), ('n', 'n')))}
      FROM sv WINDOW w AS (PARTITION BY symbol ORDER BY n, kind)) WHERE kind = k2 AND kind = k4 AND k1 = k3 AND kind <> k1 AND abs(price / nullif(p4, 0) - 1) <= {0.05}))""",
    """tl AS MATERIALIZED (SELECT *, regr_slope(CASE WHEN kind = 'high' THEN price END, CASE WHEN kind = 'high' THEN n::double END) OVER f AS hs, regr_intercept(CASE WHEN kind = 'high' THEN price END, CASE WHEN kind = 'high' THEN n::double END) OVER f AS hb,
      regr_slope(CASE WHEN kind = 'low' THEN price END, CASE WHEN kind = 'low' THEN n::double END) OVER f AS ls, regr_intercept(CASE WHEN kind = 'low' THEN price END, CASE WHEN kind = 'low' THEN n::double END) OVER f AS lb,
      avg(CASE WHEN kind = 'high' THEN price END) OVER f AS hm, avg(CASE WHEN kind = 'low' THEN price END) OVER f AS lm, count(CASE WHEN kind = 'high' THEN 1 END) OVER f AS h, count(CASE WHEN kind = 'low' THEN 1 END) OVER f AS l, min(n) OVER f AS n0
      FROM sv WINDOW f AS (PARTITION BY symbol ORDER BY n, kind ROWS BETWEEN 5 PRECEDING AND CURRENT ROW))""",
    "tw AS MATERIALIZED (SELECT *, hs / nullif(hm, 0) AS hw, ls / nullif(lm, 0) AS lw, (hb + hs * n0) - (lb + ls * n0) AS width, hb + hs * n AS top, lb + ls * n AS bottom FROM tl WHERE h = 3 AND l = 3)",
    """tn AS MATERIALIZED (SELECT *, CASE WHEN abs(hw) <= 0.0005 AND lw > 0.0005 THEN 'ascending_triangle' WHEN hw < -0.0005 AND abs(lw) <= 0.0005 THEN 'descending_triangle' WHEN hw < -0.0005 AND lw > 0.0005 THEN 'symmetrical_triangle'
      WHEN hw > 0.0005 AND lw > 0.0005 THEN 'rising_wedge' WHEN hw < -0.0005 AND lw < -0.0005 THEN 'falling_wedge' END AS pattern FROM tw WHERE top - bottom > 0 AND top - bottom < width)""",
]


@register(
    "chart_patterns",
    q(
        """SELECT symbol, ts, confirmed, CASE kind WHEN 'high' THEN 'head_and_shoulders' ELSE 'inverse_head_and_shoulders' END AS pattern, CASE kind WHEN 'high' THEN 'bearish' ELSE 'bullish' END AS direction, round(edge, 2) AS breakout_level, round(edge - height, 2) AS measured_target
        FROM hs WHERE kind = 'high' AND p2 > greatest(price, p4) AND height > 0 OR kind = 'low' AND p2 < least(price, p4) AND height < 0 UNION ALL
        SELECT symbol, ts, confirmed, pattern, CASE WHEN pattern IN ('ascending_triangle', 'falling_wedge') THEN 'bullish' WHEN pattern = 'symmetrical_triangle' THEN 'neutral' ELSE 'bearish' END,
          round(CASE WHEN pattern IN ('descending_triangle', 'rising_wedge') THEN bottom ELSE top END, 2), round(CASE WHEN pattern IN ('descending_triangle', 'rising_wedge') THEN bottom - width ELSE top + width END, 2) FROM tn WHERE pattern IS NOT NULL""",
        *_SEQUENCE,
    ),
)
def chart_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chart.chart_patterns(src.brand_week(spark, sf_dir))
    return found.withColumns({c: F.round(c, 2) for c in ("breakout_level", "measured_target")})
