"""Hand-computed values, invariants and look-ahead of the operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.functions.tick import round_to_tick, tick_size
from tickloom.operators import indicators as ind
from tickloom.operators import relational as rel
from tickloom.operators import structure as st
from tickloom.sources import bars as src


def series(spark, close, high=None, low=None, open_=None, volume=None, symbol="X", start="2026-01-05"):
    n = len(close)
    frame = pd.DataFrame({"symbol": symbol, "ts": pd.date_range(start, periods=n), "open": open_ or close, "high": high or close, "low": low or close, "close": close, "volume": volume or [100] * n})
    frame = frame.astype({c: float for c in ("open", "high", "low", "close")})
    return spark.createDataFrame(frame).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def walk(spark, n=400, seed=7, symbol="X"):
    rng = np.random.default_rng(seed)
    close = 1000 + np.cumsum(rng.normal(0, 8, n))
    open_ = close + rng.normal(0, 4, n)
    high, low = np.maximum(open_, close) + rng.uniform(0, 5, n), np.minimum(open_, close) - rng.uniform(0, 5, n)
    return series(spark, list(close), list(high), list(low), list(open_), list(rng.integers(1, 1000, n)), symbol)


def values(df, column):
    return [r[column] for r in df.orderBy("ts").collect()]


def test_means(spark):
    """Against a loop over a series with steps up and down."""
    close = [7.0, 7.5, 6.25, 9.0, 9.0, 3.5, 12.0, 11.0, 4.75]
    bars = series(spark, close)
    assert values(bars.withColumn("m", ind.sma(4)), "m") == [None if i < 3 else pytest.approx(math.fsum(close[i - 3 : i + 1]) / 4) for i in range(len(close))]
    mean, want = close[0], []
    for x in close:
        mean = mean + 2 / 6 * (x - mean)
        want.append(mean)
    assert values(ind.add_ema(bars, 5), "ema5") == pytest.approx(want)


def test_long_series_do_not_overflow(spark):
    n = 6000
    rng = np.random.default_rng(1)
    close = 100 + rng.normal(0, 1, n)
    got = values(ind.add_ema(series(spark, list(close)), 3, 200), "ema3")
    want = pd.Series(close).ewm(span=3, adjust=False).mean()
    assert max(abs(a - b) for a, b in zip(got, want)) < 1e-9
    assert max(abs(a - b) for a, b in zip(values(ind.add_ema(series(spark, list(close)), 200), "ema200"), pd.Series(close).ewm(span=200, adjust=False).mean())) < 1e-9


def test_rsi(spark):
    close = list(1000 + np.cumsum(np.random.default_rng(3).normal(0, 5, 200)))
    got = values(ind.add_rsi(series(spark, close)), "rsi")
    gain = loss = None
    for i in range(1, 200):
        d = close[i] - close[i - 1]
        if i == 14:
            ds = np.diff(close[:15])
            gain, loss = ds.clip(min=0).mean(), (-ds).clip(min=0).mean()
        elif i > 14:
            gain, loss = (gain * 13 + max(d, 0)) / 14, (loss * 13 + max(-d, 0)) / 14
        if i < 14:
            assert got[i] is None
        else:
            assert got[i] == pytest.approx(100 - 100 / (1 + gain / loss))
    flat = values(ind.add_rsi(series(spark, [5.0] * 20)), "rsi")
    assert flat[13] is None and flat[14] == 100
    assert set(values(ind.add_rsi(series(spark, [5.0] * 10)), "rsi")) == {None}


def test_volume(spark):
    """Running sums against a loop over a walk with unchanged closes and bars without range."""
    rng = np.random.default_rng(21)
    close = list(40 + np.cumsum(rng.integers(-2, 3, 60)).astype(float))
    high, low = [c + (i % 4) for i, c in enumerate(close)], [c - (i % 3) for i, c in enumerate(close)]
    volume = [int(v) for v in rng.integers(1, 500, 60)]
    bars = series(spark, close, high, low, volume=volume)
    flow = spread = 0.0
    flows, spreads = [], []
    for i, (c, h, l, v) in enumerate(zip(close, high, low, volume)):
        flow += 0 if i == 0 or c == close[i - 1] else v if c > close[i - 1] else -v
        spread += 0 if h == l else v * (2 * c - h - l) / (h - l)
        flows.append(flow)
        spreads.append(spread)
    assert values(ind.add_obv(bars), "obv") == flows
    assert values(ind.add_accumulation_distribution(bars), "accum_dist") == pytest.approx(spreads)


def test_pivots(spark):
    """Each level of an own bar lies where its method says, as a multiple of the bar's range from the pivot or the close."""
    high, low, close = 64.0, 48.0, 59.0
    one = spark.range(1)
    told = lambda m: one.select(*[c.alias(k) for k, c in st.pivots(F.lit(high), F.lit(low), F.lit(close), m).items()]).first().asDict()
    middle, span = 57.0, 16.0
    classic = told("classic")
    assert classic["pp"] == middle and [classic["r1"] - middle, middle - classic["s1"]] == [middle - low, high - middle]
    assert [classic["r2"] - classic["s2"], classic["r3"] - classic["r1"], classic["s1"] - classic["s3"]] == [2 * span, span, span]
    for i, share in ((1, 0.382), (2, 0.618), (3, 1.0)):
        assert [told("fibonacci")[f"{side}{i}"] for side in "rs"] == pytest.approx([middle + share * span, middle - share * span])
    for i, part in ((1, 12), (2, 6), (3, 4), (4, 2)):
        assert [told("camarilla")[f"{side}{i}"] for side in "rs"] == pytest.approx([close + 1.1 * span / part, close - 1.1 * span / part])
    with pytest.raises(ValueError):
        st.pivots(F.lit(1.0), F.lit(1.0), F.lit(1.0), "other")


def test_swings(spark):
    """Against a loop over a walk of small steps, which has many ties."""
    rng = np.random.default_rng(11)
    middle = 50 + np.cumsum(rng.integers(-1, 2, 200))
    high, low = (middle + rng.integers(0, 2, 200)).astype(float), (middle - rng.integers(0, 2, 200)).astype(float)
    rows = st.add_swings(series(spark, list(middle.astype(float)), list(high), list(low)), 3)

    def only(x, i, best):
        around = x[i - 3 : i + 4]
        return 3 <= i < len(x) - 3 and x[i] == best(around) and (around == x[i]).sum() == 1

    tops, bottoms = values(rows, "swing_high"), values(rows, "swing_low")
    assert tops == [only(high, i, max) for i in range(200)] and sum(tops) > 5
    assert bottoms == [only(low, i, min) for i in range(200)] and sum(bottoms) > 5
    assert not any(values(st.add_swings(series(spark, [5.0] * 20), 3), "swing_high"))


def test_ticks(spark):
    """Against whole-number arithmetic over every price from 1 to 7,000."""
    prices = spark.range(1, 7001).select(F.col("id").cast("int").alias("p"))
    rows = prices.select("p", tick_size(F.col("p")).alias("tick"), *[round_to_tick(F.col("p"), h).cast("int").alias(h) for h in ("down", "up", "nearest")]).collect()
    bands = [(0, 1), (200, 2), (500, 5), (2000, 10), (5000, 25)]
    for r in rows:
        tick = max(b for b in bands if b[0] <= r.p)[1]
        assert (r.tick, r.down, r.up, r.nearest) == (tick, r.p // tick * tick, -(-r.p // tick) * tick, (2 * r.p + tick) // (2 * tick) * tick)
    assert spark.range(1).select(round_to_tick(F.lit(0), "down"), round_to_tick(F.lit(-3), "up")).first() == (None, None)


@pytest.mark.parametrize(("step", "expected"), [(-3.0, "hammer"), (3.0, "hanging_man"), (0.0, None)])
def test_hammer(spark, step, expected):
    """A small body with a long wick below it, after seven bars that fall, rise or stay."""
    close = [400 + step * i for i in range(7)]
    last = close[-1] + step
    bars = series(spark, [*close, last + 2], [*(c + 1 for c in close), last + 2.5], [*(c - 1 for c in close), last - 14], [*(c - step / 4 for c in close), last])
    found = {r.pattern for r in st.candle_patterns(bars).filter(F.col("ts") == dt.datetime(2026, 1, 12)).collect()}
    assert (expected in found) if expected else not found & {"hammer", "hanging_man"}


def test_invariants(spark):
    bars = walk(spark).unionByName(walk(spark, seed=9, symbol="Y"))
    rows = ind.add_mfi(ind.add_stochastic(ind.add_rsi(bars)))
    for c in ("rsi", "mfi", "stoch_k", "stoch_d"):
        lo, hi = rows.agg(F.min(c), F.max(c)).first()
        assert 0 <= lo <= hi <= 100
    area = ind.value_area(bars).collect()
    assert all(r.val <= r.poc <= r.vah for r in area)
    total = {r.symbol: r.v for r in ind.tail(bars, 250).groupBy("symbol").agg(F.sum("volume").alias("v")).collect()}
    assert {r.symbol: r.v for r in ind.volume_buckets(bars).groupBy("symbol").agg(F.sum("volume").alias("v")).collect()} == total
    levels = st.price_levels(bars).collect()
    assert all(r.strength >= 40 for r in levels)
    assert max(sum(1 for r in levels if (r.symbol, r.level_type) == k) for k in {(r.symbol, r.level_type) for r in levels}) <= 8


def test_no_look_ahead(spark):
    bars = walk(spark, 260)
    cut = dt.datetime(2026, 1, 5) + dt.timedelta(days=199)
    add = lambda b: ind.add_bollinger(ind.add_macd(ind.add_rsi(b)))
    whole = add(bars).filter(F.col("ts") <= cut)
    part = add(bars.filter(F.col("ts") <= cut))
    for c in ("rsi", "macd", "bb_upper"):
        assert values(whole, c) == pytest.approx(values(part, c))
    trades = lambda b: {tuple(r) for r in rel.backtest(b).collect() if r.exit_ts <= cut}
    assert trades(bars) == trades(bars.filter(F.col("ts") <= cut))


def test_validation(spark):
    close = [1000.0 + i for i in range(30)]
    gap = lambda *at: [None if i in at else c for i, c in enumerate(close)]
    bars = lambda c, v=None: series(spark, c, volume=v).withColumn("close", F.when(~F.isnan("close"), F.col("close")))
    fine = rel.validation_report(bars(gap(10, 11)), "swing").first()
    assert (fine.filled, fine.longest_gap, fine.status) == (2, 2, "short")
    assert rel.validation_report(bars(gap(10, 11, 12)), "swing").first().status == "gap"
    assert rel.validation_report(bars(close, [0 if i == 3 else 5 for i in range(30)]), "day").first().suspended == 1
    jump = bars([c * (1.4 if i >= 20 else 1) for i, c in enumerate(close)])
    assert rel.corporate_actions(jump).count() == 1
    assert values(rel.fill_gaps(bars(gap(10, 11))), "close")[10:12] == [1009.0, 1009.0]
    with pytest.raises(ValueError):
        rel.validation_report(bars(close), "other")


def test_summary(spark):
    names = spark.createDataFrame([("A", "s"), ("B", "s"), ("C", "s")], "symbol string, sector string")
    bars = series(spark, [10.0, 12.0], symbol="A").unionByName(series(spark, [5.0], symbol="B"))
    got = {r.symbol: (r.last_price, r.change_pct) for r in rel.summary(names, bars).collect()}
    assert got["A"] == (12.0, pytest.approx(20)) and got["B"] == (5.0, None) and got["C"] == (None, None)


def test_resample_weeks(spark):
    weeks = src.resample(series(spark, [float(i) for i in range(10)]), "week").orderBy("ts").collect()
    assert [(r.ts.weekday(), r.open, r.close, r.volume) for r in weeks] == [(0, 0, 6, 700), (0, 7, 9, 300)]


def test_store_round_trip(spark, tmp_path):
    bars = spark.createDataFrame([(1, "1d", dt.datetime(2026, 1, d), 1, 2, 1, 2, 10) for d in (5, 6)] + [(1, "1w", dt.datetime(2026, 2, 2), 1, 2, 1, 2, 10)], "instrument_id long, timeframe string, ts timestamp, open int, high int, low int, close int, volume int")
    src.write_store(bars, str(tmp_path / "s"))
    assert src.read_store(spark, str(tmp_path / "s"), timeframe="1d", start="2026-01-06", stop="2026-01-31").count() == 1
    with pytest.raises(ValueError):
        src.read_store(spark, str(tmp_path / "s"), timeframe="2d")


def test_empty(spark):
    none = walk(spark, 5).limit(0)
    for make in (ind.add_rsi, ind.add_psar, ind.add_supertrend, ind.value_area, st.price_levels, st.candle_patterns, rel.backtest, rel.sparkline):
        assert make(none).count() == 0


def test_supertrend_short(spark):
    rows = ind.add_supertrend(walk(spark, 10)).collect()
    assert all(r.supertrend is None and r.direction == "up" for r in rows)
    assert math.isfinite(ind.add_supertrend(walk(spark, 12)).agg(F.max("supertrend")).first()[0])


def loop_supertrend(high, low, close, period, times):
    """The definition, bar by bar; NaN compares false."""
    n, nan = len(close), float("nan")
    tr = [np.nanmax([high[i] - low[i], *(([abs(high[i] - close[i - 1]), abs(low[i] - close[i - 1])]) if i else [])]) if not np.isnan(high[i]) else nan for i in range(n)]
    first = next(i for i in range(n) if not np.isnan(tr[i]))
    atr = [nan] * n
    for i in range(first + period - 1, n):
        atr[i] = np.nanmean(tr[first : i + 1]) if i == first + period - 1 else (atr[i - 1] * (period - 1) + tr[i]) / period
    out = []
    for i in range(n):
        if i < period:
            out.append((None, "up"))
            continue
        u, l = (high[i] + low[i]) / 2 + times * atr[i], (high[i] + low[i]) / 2 - times * atr[i]
        if i > period:
            u = u if u < up or close[i - 1] > up else up
            l = l if l > down or close[i - 1] < down else down
            way = ("down" if close[i] < l else "up") if way == "up" else ("up" if close[i] > u else "down")
        else:
            way = "up" if close[i] > l else "down"
        up, down = u, l
        out.append((l if way == "up" else u, way))
    return out


def test_supertrend_against_a_loop(spark):
    rng = np.random.default_rng(5)
    close = 100 + np.cumsum(rng.standard_t(2, 300))
    high, low = close + rng.uniform(0, 2, 300), close - rng.uniform(0, 2, 300)
    flat = [7.0] * 40
    for c, h, l in ((list(close), list(high), list(low)), (flat, flat, flat)):
        got = [(r.supertrend, r.direction) for r in ind.add_supertrend(series(spark, c, h, l), 10, 3.0).orderBy("ts").collect()]
        want = loop_supertrend(h, l, c, 10, 3.0)
        assert [g[1] for g in got] == [w[1] for w in want]
        assert all(a[0] is None if b[0] is None else a[0] == pytest.approx(b[0]) for a, b in zip(got, want))
    assert {r.direction for r in ind.add_supertrend(series(spark, flat)).filter(F.dayofyear("ts") > 20).collect()} == {"down"}


def test_nulls_in_recurrences(spark):
    """A mean over a null keeps its value; Wilder's smoothing is null after one, but not when the null is in its first rows."""
    close = [100.0] * 30
    close[12] = None
    bars = lambda c: series(spark, c).withColumns({x: F.when(~F.isnan(x), F.col(x)) for x in ("open", "high", "low", "close")})
    assert values(ind.add_ema(bars(close), 8), "ema8") == pytest.approx([100.0] * 30)
    uneven = [float(i * i % 17) for i in range(40)]
    uneven[0] = uneven[5] = uneven[21] = None
    want = pd.Series(uneven, dtype=float).ewm(span=5, adjust=False).mean()
    assert values(ind.add_ema(bars(uneven), 5), "ema5")[1:] == pytest.approx(list(want[1:]))
    atr = values(ind.add_atr(bars([None, 5.0, 5.0, 5.0, 5.0, None, 5.0]), 3), "atr")
    assert atr == [None, None, None, 0.0, 0.0, None, None]


def test_errors(spark):
    names = spark.createDataFrame([("ABC", "X"), ("DEF", "X"), ("DEF", "Y")], "symbol string, exchange string")
    assert rel.one_instrument(names, "abc").symbol == "ABC" and rel.one_instrument(names, "def", exchange="Y").exchange == "Y"
    for symbol in ("none", "def"):
        with pytest.raises(rel.NotFound):
            rel.one_instrument(names, symbol)
    assert rel.search(names, exchange="Y").count() == 1
    with pytest.raises(rel.InsufficientData):
        rel.require_bars(walk(spark, 59))
    assert rel.require_bars(walk(spark, 60)).count() == 60


def test_snapshot(spark):
    from tickloom.operators import snapshot as snap

    bars = walk(spark, 260).unionByName(walk(spark, 30, seed=2, symbol="Y"))
    rows = {r.symbol: r for r in snap.snapshot(bars).collect()}
    assert rows["X"].trend.sma200 is not None and rows["Y"].trend.sma50 is None and rows["Y"].trend.ema200 is not None
    assert rows["X"].volume.val <= rows["X"].volume.poc <= rows["X"].volume.vah
    assert rows["X"].trend.chikou is None and rows["X"].momentum.divergence is None
    text = snap.as_json(snap.snapshot(bars)).filter("symbol = 'X'").first().payload
    assert '"volatility":{"atr":' in text


def test_ingest(spark):
    ts = dt.datetime(2026, 1, 5)
    rows = [(1, ts, 1.0, None), (1, ts + dt.timedelta(days=1), 2.0, None), (2, ts, 9.0, None), (2, None, None, "timeout"), (3, None, None, None)]
    loads = spark.createDataFrame(rows, "instrument_id long, ts timestamp, close double, error string").withColumn("timeframe", F.lit("1d"))
    old = loads.filter("instrument_id = 1").withColumn("close", F.lit(7.0)).limit(1)
    bars, report = src.ingest(loads, old)
    assert sorted((r.instrument_id, float(r.close)) for r in bars.collect()) == [(1, 1.0), (1, 2.0)]
    assert {(r.instrument_id, r.bars, r.status) for r in report.collect()} == {(1, 2, "loaded"), (2, 0, "failed"), (3, 0, "empty")}


def test_double_top(spark):
    from tickloom.operators import screening as scr

    price = [100.0, 102, 104, 106, 108, 110, 108, 106, 104, 102, 100, 102, 104, 106, 108, 110.5, 108, 106, 104, 102, 100]
    found = scr.double_extremes(series(spark, price), 4).collect()
    assert [(r.pattern, r.breakout_level, r.measured_target) for r in found] == [("double_top", 100.0, 200.0 - 110.25)]


def test_sessions(spark):
    from tickloom.operators import screening as scr

    times = ["2026-01-05 09:00:00", "2026-01-05 11:30:00", "2026-01-05 13:29:00", "2026-01-05 14:59:00", "2026-01-10 10:00:00"]
    rows = spark.createDataFrame([(t,) for t in times], "t string").select(scr.in_session(F.col("t").cast("timestamp_ntz")).alias("x")).collect()
    assert [r.x for r in rows] == [True, False, False, True, False]


def test_score_presets(spark):
    from tickloom.operators import screening as scr

    rows = spark.createDataFrame([(70.0, 70.0, 75.0, 40.0, None, -1.0, 10.0), (10.0, 40.0, 10.0, 60.0, 61.0, 1.0, 65.0)], "trend double, momentum double, volume double, structure double, fundamental double, change_pct double, support_strength double")
    assert [r.presets for r in scr.score_presets(rows).collect()] == [["pullback", "volume"], ["reversal", "value", "dividend"]]


def test_snapshot_over_holes(spark):
    """Every field is what its operator gives on the last bar, also over prices of 0, missing bars and volumes of 0 among the last."""
    from tickloom.operators import snapshot as snap

    n = F.col("n")
    rows = ind.numbered(walk(spark, 330).unionByName(walk(spark, 90, 5, "Y")).unionByName(walk(spark, 6, 6, "Z")))
    rows = rows.withColumns({c: F.when((n % 53) == 7, 0.0).otherwise(F.col(c)) for c in ("close", "low")}).withColumns({c: F.when(n % 61 != 9, F.col(c)) for c in ("open", "high", "low", "close")})
    rows = rows.withColumn("volume", F.when(n % 17 == 5, 0).otherwise(F.col("volume"))).drop("n").cache()
    for cut in (329, 325, 312, 300):
        bars = rows.filter(F.col("ts") <= F.lit(dt.datetime(2026, 1, 4) + dt.timedelta(days=cut)))
        told = bars.withColumns({**{f"sma{k}": ind.sma(k) for k in snap.SMA}, "williams_r": ind.williams_r(), "roc": ind.roc(), "volume_ma": ind.sma(20, "volume"), "relative_volume": ind.relative_volume(), "vwap": ind.vwap()})
        for add in (ind.add_bollinger, ind.add_donchian, ind.add_historical_volatility, ind.add_obv, ind.add_accumulation_distribution, ind.add_ichimoku, ind.add_stochastic, ind.add_stoch_rsi, ind.add_mfi, ind.add_cci, st.daily_pivots):
            told = add(told)
        want = {r.symbol: r.asDict() for r in ind.tail(told, 1).collect()}
        for r in ind.value_area(bars).collect():
            want[r.symbol] |= dict(poc=r.poc, vah=r.vah, val=r.val) if r.symbol != "Z" else {}
        for r in st.fibonacci_levels(bars).collect():
            want[r.symbol] |= r.asDict()
        for r in snap.snapshot(bars).select("symbol", *[f"{g}.*" for g in snap.FIELDS]).collect():
            for c, x in r.asDict().items():
                y = want[r.symbol].get(c)
                if c in want[r.symbol]:
                    assert (x is None) == (y is None) and (x is None or isinstance(x, str) or x == pytest.approx(y, rel=1e-9, abs=1e-9)), (cut, r.symbol, c, x, y)
                elif c in (*snap.RETRACEMENTS, *snap.EXTENSIONS, "poc", "vah", "val"):
                    assert x is None, (cut, r.symbol, c, x)
