"""The signal engine, plans against levels, stored screeners, fundamentals, ranges, and series by other keys, against own loops."""

import random

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tickloom.operators import engine, fundamentals, leveled, ranges, recurrence, relational, screening, snapshot, stored, structure
from tickloom.operators.series import keyed_by
from tickloom.sources import bars as src

BARS = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint, value double"


def series(spark, seed=1, symbols="AB", n=320, start=3000.0):
    rng = random.Random(seed)
    rows = []
    for s in symbols:
        price = start
        for i in range(n):
            before, price = price, max(100.0, price * (1 + rng.gauss(0.0015, 0.012)))
            high, low = max(before, price) * (1 + rng.random() * 0.006), min(before, price) * (1 - rng.random() * 0.006)
            volume = rng.randrange(1_000_000, 9_000_000)
            rows.append((s, i, before, high, low, price, volume, price * volume))
    df = spark.createDataFrame(rows, "symbol string, i int, open double, high double, low double, close double, volume bigint, value double")
    return df.select("symbol", F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, i)").alias("ts"), "open", "high", "low", "close", "volume", "value")


@pytest.fixture(scope="module")
def bars(spark):
    return series(spark, start=5000.0).cache()


def trades_by_hand(rows, mode):
    """The rules of signal_backtest(), position by position, over a series' scored bars."""
    slip, shares, out, i = engine.SLIPPAGE[mode], (0.4, 0.3, 0.3), [], 1
    while i < len(rows):
        p = rows[i - 1]
        if not (p.score >= 65 and p.limit is not None and p.stop is not None and p.limit > p.stop and rows[i].low <= p.limit and rows[i].open > p.stop):
            i += 1
            continue
        paid, stop, parts = min(rows[i].open, p.limit) * (1 + slip), p.stop, []
        at = i
        while at < len(rows):
            bar = rows[at]
            if at > i and parts:
                stop = max(stop, paid)
                if len(parts) >= 2:
                    stop = max(stop, rows[at - 1].trail)
            if bar.low <= stop:
                parts.append((1 - sum(s for s, _ in parts), min(bar.open, stop) * (1 - slip)))
                break
            while at > i and len(parts) < 3 and bar.high >= (p.tp1, p.tp2, p.tp3)[len(parts)]:
                parts.append((shares[len(parts)], max(bar.open, (p.tp1, p.tp2, p.tp3)[len(parts)]) * (1 - slip)))
            if len(parts) == 3:
                break
            at += 1
        if at == len(rows):
            return out
        got = sum(s * x for s, x in parts)
        out.append((rows[i].ts, rows[at].ts, round(paid, 6), round(got, 4), round((got - paid) / (paid - p.stop), 6)))
        i = at + 1
    return out


@pytest.mark.parametrize("mode", ["swing", "scalping", "investing"])
def test_backtest_by_hand(spark, bars, mode):
    rows = engine.fold(bars.withColumn("volume", F.col("volume").cast("double")), *engine.signal_steps(mode)).orderBy("ts").collect()
    got = engine.signal_backtest(bars, mode).collect()
    for s in "AB":
        want = trades_by_hand([r for r in rows if r.symbol == s], mode)
        assert sorted((r.entry_ts, r.exit_ts, round(r.entry, 6), round(r.exit, 4), round(r.r, 6)) for r in got if r.symbol == s) == want
    assert mode != "swing" or {r.targets for r in got} >= {0, 3}


def test_backtest_sees_no_later_bar(spark, bars):
    """Without its last 80 bars a series has the same trades up to there, and every bar the same plan."""
    cut = bars.filter("ts < timestamp_ntz '2024-08-28'")
    last = cut.agg(F.max("ts")).first()[0]
    pick = lambda b: sorted(tuple(r)[:-1] for r in engine.signal_backtest(b).filter(F.col("exit_ts") <= F.lit(last)).collect())
    assert pick(cut) == pick(bars) and pick(cut)
    early = engine.signals(bars, "swing").filter(F.col("ts") <= F.lit(last))
    assert early.exceptAll(engine.signals(cut, "swing")).count() == 0


LEVELS = "symbol string, level_type string, price double, strength double"


def test_targets_give_way_to_levels(spark, bars):
    """A strong resistance near a target takes its place, a tick below; weak and distant ones don't; the extension caps the third; each limit can decide the lots."""
    none = spark.createDataFrame([], LEVELS)
    plain = {r.symbol: r for r in leveled.level_plan(bars, none, "swing").collect()}
    assert all(r.snapped == 0 for r in plain.values())
    atr = {r.symbol: r.atr for r in recurrence.fold(bars, recurrence.atr("atr", 14)).orderBy("ts").collect()}
    a, b = plain["A"], plain["B"]
    near = spark.createDataFrame([("A", "resistance", a.tp2 + 0.3 * atr["A"], 70.0), ("A", "resistance", a.tp1 + 0.2 * atr["A"], 55.0), ("B", "resistance", b.tp1 + 0.45 * atr["B"], 61.0), ("B", "support", b.tp2, 99.0)], LEVELS)
    got = {r.symbol: r for r in leveled.level_plan(bars, near, "swing").collect()}
    below = lambda level: (level - 25) // 25 * 25  # noqa: E731  the tick from 5000 on
    assert min(a.entry, b.entry) > 5000 and (got["A"].tp1, got["A"].tp2, got["A"].snapped) == (a.tp1, below(a.tp2 + 0.3 * atr["A"]), 1)
    assert (got["B"].tp1, got["B"].tp2, got["B"].snapped) == (below(b.tp1 + 0.45 * atr["B"]), b.tp2, 1)
    bounds = {name: leveled.level_plan(bars, none, "swing", capital=c).first().bound for name, c in (("small", 1e6), ("large", 1e13))}
    assert bounds["large"] == "volume" and bounds["small"] in ("risk", "exposure")
    # a short range just ahead: the extension of the last swings lies between the second and the third target
    capped = [leveled.level_plan(series(spark, seed, "A", 120), none, "swing").first() for seed in range(8)]
    fib = [structure.fibonacci_levels(series(spark, seed, "A", 120)).first() for seed in range(8)]
    for plan, level in zip(capped, fib):
        assert plan.capped == (level is not None and plan.tp2 < level.e1618 and plan.tp3 <= level.e1618 < plan.entry + 4 * plan.risk)
    assert any(p.capped for p in capped)


def test_clusters(spark):
    """Chained within the tolerance, the heaviest first, of equals the dearer; no candidate, no cluster."""
    rows = [([(10.0, "a", 50.0), (10.4, "b", 60.0), (10.9, "c", 10.0), (20.0, "d", 100.0)], 0.5), ([(5.0, "a", 60.0), (9.0, "b", 60.0)], 0.5), ([], 0.5), ([(5.0, "a", 60.0)], None)]
    df = spark.createDataFrame(rows, "c array<struct<price:double,source:string,weight:double>>, t double")
    got = [r.x for r in df.select(leveled.clustered(F.col("c"), F.col("t")).alias("x")).collect()]
    assert got[0].sources == ["a", "b", "c"] and abs(got[0].price - (500 + 624 + 109) / 120) < 1e-9 and got[0].weight == 120
    assert got[1].sources == ["b"] and got[2] is None and got[3].sources == ["a"]


def test_stored_screeners(spark, bars):
    rows = [("cheap", "rsi", "<", 45.0, None, None), ("cheap", "close", "<", 1.0, None, "ema20"), ("mid", "rsi", "between", 45.0, 55.0, None), ("same", "close", "=", None, None, "close")]
    got = stored.run_screeners(bars, spark.createDataFrame(rows, stored.CONDITIONS), last=None).collect()
    told = recurrence.fold(bars, recurrence.rsi("rsi", 14), recurrence.ema("ema20", "close", 20)).collect()
    want = [(r.symbol, r.ts, s) for r in told for s, ok in (("cheap", r.rsi is not None and r.rsi < 45 and r.close < r.ema20), ("mid", r.rsi is not None and 45 <= r.rsi <= 55), ("same", True)) if ok]
    assert sorted((r.symbol, r.ts, r.screener) for r in got) == sorted(want)
    last = stored.run_screeners(bars, spark.createDataFrame(rows[-1:], stored.CONDITIONS)).collect()
    assert len(last) == 2
    assert stored.run_screeners(bars, spark.createDataFrame([], stored.CONDITIONS)).count() == 0
    for bad in (("x", "shoe_size", "<", 1.0, None, None), ("x", "rsi", "~", 1.0, None, None)):
        with pytest.raises(ValueError):
            stored.run_screeners(bars, spark.createDataFrame([bad], stored.CONDITIONS))
    bars = bars.withColumn("frequency", F.lit(1))
    every = stored.with_fields(bars, stored.FIELDS)
    assert set(stored.FIELDS) <= set(every.columns) and every.count() == bars.count()


def test_piotroski_and_fair_value(spark):
    """Eight quarters of a firm that gets better in each of the nine ways, and of one that does not; five years of dividends."""
    rows = []
    for i in range(24):
        period = f"{2018 + i // 4}-{1 + i % 4 * 3:02d}-01"
        up = 1.02**i
        base = dict(sector="s", period=period, free_cash_flow=8.0 * up, equity=500.0, price=40.0)
        rows.append(Row(symbol="good", revenue=100 * up, gross_profit=40 * up * (1 + i / 100), net_income=10 * up, cash_flow=12 * up, assets=800.0, debt=300.0 - i, current_assets=100.0 + i, current_liabilities=80.0, shares=10.0, dividends=2.0, **base))
        rows.append(Row(symbol="bad", revenue=100 / up, gross_profit=40 / up / (1 + i / 100), net_income=-10.0, cash_flow=-12.0, assets=800.0, debt=300.0 + i, current_assets=100.0 - i, current_liabilities=80.0, shares=10.0 + i, dividends=0.0, **(base | dict(free_cash_flow=-1.0))))
    df = spark.createDataFrame(rows).withColumn("period", F.col("period").cast("timestamp_ntz"))
    got = {r.symbol: r for r in fundamentals.assess(df).filter("period = timestamp_ntz '2023-10-01'").collect()}
    assert got["good"].f_score == 9 and got["bad"].f_score == 0
    g = got["good"]
    assert abs(g.eps - sum(10 * 1.02**i for i in range(20, 24)) / 10) < 1e-9 and g.methods == 4
    cash, growth = sum(8 * 1.02**i for i in range(20, 24)), 1.02**4 - 1
    flows = [cash * (1 + growth) ** y for y in range(1, 6)]
    dcf = sum(f / 1.15**y for y, f in enumerate(flows, 1)) + flows[-1] * 1.03 / 0.12 / 1.15**5
    assert abs(g.value_dcf - dcf / 10) < 1e-6 and abs(g.value_ddm - 8 / 10 * 1.03 / 0.12) < 1e-9
    assert abs(g.fair_low - np.percentile([g.value_per, g.value_pbv, g.value_dcf, g.value_ddm], 25)) < 1e-9
    assert got["bad"].value_dcf is None and got["bad"].value_ddm is None and got["bad"].per is None
    assert g.fundamental_score > got["bad"].fundamental_score


@pytest.mark.parametrize("n", [1, 7, 256])
def test_as_of_by_ranges(spark, n):
    rng = random.Random(n)
    left = [(i, rng.choice("ABC"), rng.choice([None, rng.randrange(100)])) for i in range(200)]
    right = [(rng.choice("AB"), rng.choice([None, rng.randrange(100)]), float(i)) for i in range(40)]
    schema = "s string, t int"
    l, r = spark.createDataFrame(left, "i int, " + schema), spark.createDataFrame(right, schema + ", v double")
    got = {x.i: x.v for x in ranges.as_of(l, r, by=["s"], on="t", values=["v"], ranges=n).collect()}
    for i, s, t in left:
        met = [(at, v) for key, at, v in right if key == s and at is not None and t is not None and at <= t]
        assert got[i] == (max(met)[1] if met else None)
    assert ranges.as_of(l, r.limit(0), by=["s"], on="t", values=["v"]).filter("v IS NULL").count() == 200
    assert ranges.as_of(l.limit(0), r, by=["s"], on="t", values=["v"]).count() == 0


@pytest.mark.parametrize("n", [1, 5, 400])
def test_means_by_ranges(spark, bars, n):
    """Also over nulls at either end of a range, and ranges without any value."""
    day = F.dayofyear("ts")
    holed = bars.withColumn("close", F.when(~(day.between(1, 4) | day.between(60, 140) | (day % 11 == 0)), F.col("close")))
    want = {(r.symbol, r.ts): (r.ema8, r.ema21) for r in recurrence.fold(holed, recurrence.ema("ema8", "close", 8), recurrence.ema("ema21", "close", 21)).collect()}
    got = ranges.add_ema(holed, 8, 21, ranges=n).collect()
    assert len(got) == len(want)
    for r in got:
        for a, b in zip((r.ema8, r.ema21), want[r.symbol, r.ts]):
            assert (a is None or a != a) == (b is None or b != b) and (a is None or a != a or abs(a - b) < 1e-6)


def test_decimal_prices(spark, bars):
    """Bars in the types of the store fold like doubles."""
    stored_ = bars.withColumns({c: F.col(c).cast("decimal(18,4)") for c in ("open", "high", "low", "close")})
    pick = lambda b: sorted((r.symbol, r.ts, round(r.e, 6)) for r in recurrence.fold(b, recurrence.ema("e", "close", 8)).collect())
    assert pick(stored_) == pick(stored_.withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close")}))


def test_series_by_two_columns(spark, bars):
    """All operators under another key give what they give under one."""
    two = bars.withColumns({"instrument_id": F.ascii("symbol"), "timeframe": F.lit("1d")}).drop("symbol")
    one = bars.withColumn("symbol", F.ascii("symbol").cast("string"))
    made = {
        "snapshot": lambda b: snapshot.snapshot(b).select("ts", "close", "trend.*"), "levels": lambda b: structure.price_levels(b).select("level_type", "price", "strength"), "patterns": lambda b: structure.candle_patterns(b).select("ts", "pattern"),
        "plan": lambda b: relational.trade_plan(b, "swing").select("entry", "stop", "tp3"), "backtest": lambda b: relational.backtest(b).select("entry_ts", "r"), "signal_backtest": lambda b: engine.signal_backtest(b).select("entry_ts", "r"),
        "resample": lambda b: src.resample(b, "week").select("ts", "close"), "leveled": lambda b: leveled.level_plan(b, structure.price_levels(b), "swing").select("entry", "tp3", "lots"), "zone": lambda b: leveled.clustered_zone(b, structure.price_levels(b), "day").select("zone_low", "trigger"),
        "quotes": lambda b: screening.quotes(b).select("last_price"), "means": lambda b: ranges.add_ema(b, 8).select("ts", "ema8"),
        "journal": lambda b: relational.journal(b.withColumns({"side": F.lit("long"), "qty": F.lit(1), "avg_entry": F.col("open"), "stop": F.col("low") - 1, "exit": F.col("close")})).select("trades", "total_pnl"),
        "signals": lambda b: relational.signals(b.withColumns({"score": F.col("close"), "action": F.lit("buy")}), least=100.0, limit=5).select("ts", "score"),
    }
    plain = lambda df: sorted(repr([round(v, 5) if isinstance(v, float) else v for v in r]) for r in df.collect())
    for name, make in made.items():
        with keyed_by("instrument_id", "timeframe"):
            got = plain(make(two))
        assert got == plain(make(one)), name
        assert got, name
