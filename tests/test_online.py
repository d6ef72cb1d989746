"""Recurrences, alerts and merges over streams: across micro-batches and restarts."""

import math
import random

import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tickloom.operators import recurrence as rec
from tickloom.operators.series import keyed_by
from tickloom.sources import store
from tickloom.streaming import alerts, online
from tickloom.streaming.bars import merge_bars
from tickloom.streaming.replay import replay, stream_session

BARS = "symbol string, ts timestamp_ntz, high double, low double, close double"
MACHINES = (online.Ema("ema21", 21), online.Macd(), online.Atr("atr", 14), online.Rsi("rsi", 14), online.Adx(14), online.Psar(), online.SuperTrend(10, 3.0))
STEPS = (rec.ema("ema21", "close", 21), rec.macd(12, 26, 9), rec.atr("atr", 14), rec.rsi("rsi", 14), rec.adx(14), rec.psar(0.02, 0.02, 0.2), rec.supertrend(10, 3.0))
MADE = [n for m in MACHINES for n in m.made]


def bars(spark, seed, n, gaps=()):
    rng = random.Random(seed)
    rows = []
    for s in "AB":
        price = 50.0
        for i in range(n):
            price = max(1.0, price + rng.gauss(0, 1))
            high, low = price + rng.random(), price - rng.random()
            rows.append((s, i, *((None,) * 3 if i in gaps else (high, low, price))))
    df = spark.createDataFrame(rows, "symbol string, i int, high double, low double, close double")
    return df.select("symbol", F.expr("timestamp_ntz '2026-01-01 00:00:00' + make_interval(0, 0, 0, i)").alias("ts"), "high", "low", "close")


def same(a, b):
    return a == b or (a is None or b is None or isinstance(a, str)) is False and (math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9) or math.isnan(a) and math.isnan(b))


@pytest.mark.parametrize(("seed", "gaps"), [(1, ()), (2, (0, 1, 40, 41, 77))])
def test_recurrences_equal_the_batch_fold(spark, seed, gaps):
    """The bars come in four arrivals, each a query of its own from the checkpoint; the last one repeats bars that are in already."""
    rows = bars(spark, seed, 90, gaps).cache()
    day = F.datediff(F.col("ts").cast("date"), F.lit("2026-01-01"))
    twice = rows.withColumn("a", F.when(day < 3, 0).when(day < 30, 1).otherwise(2)).unionByName(rows.filter(day.between(20, 25)).withColumn("a", F.lit(3)))
    got = replay(twice, lambda s: online.stream_recurrences(s, *MACHINES), arrival=F.col("a")).collect()
    want = {(r.symbol, r.ts): r for r in rec.fold(rows, *STEPS).withColumn("n", F.row_number().over(rec_order())).collect()}
    assert len(got) == len(want) == 180
    bad = [(r.symbol, r.ts, n, r[n], want[r.symbol, r.ts][n]) for r in got for n in MADE if not (same(r[n], want[r.symbol, r.ts][n]) or n == "psar" and want[r.symbol, r.ts].n == 1)]
    assert not bad, bad[:5]


def rec_order():
    from tickloom.operators.series import in_order

    return in_order()


def test_recurrences_by_another_key(spark):
    rows = bars(spark, 3, 30).select(F.lit(7).alias("instrument_id"), F.col("symbol").alias("timeframe"), "ts", "high", "low", "close")
    with keyed_by("instrument_id", "timeframe"):
        got = replay(rows, lambda s: online.stream_recurrences(s, online.Ema("ema8", 8)), arrival=F.lit(0))
        want = rec.fold(rows, rec.ema("ema8", "close", 8))
    pick = lambda df: sorted((r.instrument_id, r.timeframe, r.ts, round(r.ema8, 9)) for r in df.collect())
    assert pick(got) == pick(want)


ALERTS = "alert_id long, symbol string, kind string, low double, high double, long boolean, wanted string, expires timestamp"


def _alerts(session, rows):
    return session.createDataFrame([(*r[:7], None if r[7] is None else f"2026-01-01 {r[7]}") for r in rows], ALERTS.replace("expires timestamp", "expires string")).withColumn("expires", F.to_timestamp("expires"))


def test_alerts_fire_once(spark):
    """Each kind once, also when the condition comes back after a restart; a cross needs a price on the other side; an expired alert says so once."""
    quotes = [("A", "00:00", 10.0, None, 0), ("A", "00:05", 12.0, None, 0), ("A", "00:10", 9.0, None, 1), ("A", "00:15", 12.5, None, 1), ("A", "00:20", None, "buy", 1), ("A", "02:00", 5.0, None, 2), ("A", "02:05", 12.0, None, 2), ("A", "02:06", None, "buy", 2), ("B", "02:00", 99.0, None, 2), ("A", "05:00", 8.0, None, 3)]
    rows = spark.createDataFrame([(s, f"2026-01-01 {t}:00", p, a, n) for s, t, p, a, n in quotes], "symbol string, ts string, price double, action string, n int").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    table = [
        (1, "A", "price_cross", 11.0, None, True, None, None),
        (2, "A", "price_cross", 9.5, None, True, None, None),
        (3, "A", "entry_zone", 8.5, 9.5, True, None, None),
        (4, "A", "sl_hit", 5.0, None, True, None, None),
        (5, "A", "sl_hit", 12.4, None, False, None, None),
        (6, "A", "signal_new", None, None, None, "buy", None),
        (7, "A", "signal_new", None, None, None, "sell", "01:00:00"),
        (8, "A", "price_cross", 7.0, None, True, None, "00:30:00"),
        (9, "A", "price_cross", 11.0, None, True, None, "00:30:00"),
        (10, "B", "price_cross", 50.0, None, True, None, None),
        (11, "C", "sl_hit", 50.0, None, True, None, "00:30:00"),
    ]
    make = lambda s: alerts.stream_alerts_once(s.select("symbol", "ts", "price", "action"), _alerts(s.sparkSession, table))
    got = replay(rows, make, arrival=F.col("n")).collect()
    told = sorted((r.alert_id, r.status, r.ts.strftime("%H:%M"), r.price) for r in got)
    assert told == [
        (1, "fired", "00:05", 12.0), (2, "fired", "00:10", 9.0), (3, "fired", "00:10", 9.0), (4, "fired", "02:00", 5.0), (5, "fired", "00:15", 12.5), (6, "fired", "00:20", None),
        (7, "expired", "01:00", None), (8, "expired", "00:30", None), (9, "fired", "00:05", 12.0),
    ]


def _random_alerts(rng, n, until):
    return [dict(alert_id=k, kind=alerts.KINDS[k % 4], low=float(rng.randint(1, 9)), high=float(rng.randint(7, 12)), long=rng.random() < 0.5, wanted=rng.choice([None, "buy", "none"]), until=rng.choice([None, *until])) for k in range(n)]


def _first(alert, rows, before=None):
    """(at, price) of the first of the rows (at, price, action), in order, that fires; and the last price."""
    for at, price, action in rows:
        if alert["until"] is None or at <= alert["until"]:
            if alerts._fires(alert["kind"], price, before, action, alert["low"], alert["high"], alert["long"], alert["wanted"]):
                return (at, price), before
            before = before if price is None else price
    return None, before


@pytest.mark.parametrize("size", [3, 400])
def test_runs_give_alerts_what_they_need(monkeypatch, size):
    """An alert gets three rows of a run at most, however many it has, and fires by them as by all rows."""
    monkeypatch.setattr(alerts, "RUN", size)
    rng = random.Random(size)
    table = _random_alerts(rng, 200, [40, 900, 5000])
    rows = [(at, None if rng.random() < 0.1 else float(rng.choice([10, 11, 12] if rng.random() < 0.98 else range(13))), rng.choice([None, None, None, "buy", "sell"])) for at in range(1, 2001)]
    given = pd.DataFrame(rng.sample(rows, len(rows)), columns=["at", "price", "action"]).assign(event_order=0)
    runs = pd.concat(alerts._Runs().handleInputRows(("A", 0), iter([given[:700], given[700:]]), None), ignore_index=True)
    assert len(runs) == -(-2000 // size) and max(map(len, runs["at"])) <= size
    batch = pa.RecordBatch.from_pylist([{"symbol": "A", "nth": int(r.nth), "at": list(map(int, r.at)), "price": [None if math.isnan(p) else p for p in r.price], "action": list(r.action), "alerts": table} for r in runs.itertuples()], pa.schema([("symbol", pa.string()), ("nth", pa.int64()), ("at", pa.list_(pa.int64())), ("price", pa.list_(pa.float64())), ("action", pa.list_(pa.string())), ("alerts", pa.list_(pa.struct([("alert_id", pa.int64()), ("kind", pa.string()), ("low", pa.float64()), ("high", pa.float64()), ("long", pa.bool_()), ("wanted", pa.string()), ("until", pa.int64())])))]))
    met = [r for b in alerts._met(iter([batch])) for r in b.to_pylist()]
    fired = 0
    for alert in table:
        own = sorted((r for r in met if r["alert_id"] == alert["alert_id"]), key=lambda r: (r["at"], r["nth"]))
        assert 0 < len(own) <= 3 * len(runs)
        before, hit = None, None
        for r in own:
            if hit is None and alerts._fires(r["kind"], r["price"], before if r["prior"] is None else r["prior"], r["action"], alert["low"], alert["high"], r["long"], r["wanted"]):
                hit = r["at"], r["price"]
            before = before if r["price"] is None else r["price"]
        assert hit == _first(alert, rows)[0], alert
        fired += hit is not None
    assert 50 < fired < 200


def test_alerts_over_spans_and_late_rows(spark):
    """Three arrivals, the later ones with rows within the delay and too late: what fires and expires is what row by row fires and expires."""
    rng = random.Random(3)
    hour, start = 3_600_000_000, 1_767_225_600_000_000
    delay, until = 2 * hour, [start + h * hour for h in (1, 7, 15, 40)]
    table = [{**a, "symbol": rng.choice("ABC")} for a in _random_alerts(rng, 120, until)]
    rows, mark, state, want = [], None, {}, set()
    for at in rng.sample(range(start, start + 24 * hour), 900):
        n = min(2, (at - start) // (8 * hour) + (rng.choice([1, 2]) if rng.random() < 0.2 else 0))
        rows.append((rng.choice("AB"), at, *((None, rng.choice(["buy", "sell"])) if rng.random() < 0.1 else (float(rng.choice([10, 11, 12] if rng.random() < 0.97 else range(13))), None)), n))
    late = 0
    for n in range(3):
        own = sorted((r for r in rows if r[4] == n and (mark is None or r[1] > mark)), key=lambda r: r[1])
        late += sum(r[4] == n for r in rows) - len(own)
        for alert in table:
            mine = [r[1:4] for r in own if r[0] == alert["symbol"] and (alert["until"] is None or r[1] <= alert["until"])]
            before, fired = state.get(alert["alert_id"], (None, False))
            if mine:
                hit, before = (None, before) if fired else _first(alert, mine, before)
                if hit:
                    want.add((alert["alert_id"], "fired", *hit))
                state[alert["alert_id"]] = before, fired or hit is not None
        mark = max(r[1] for r in rows if r[4] <= n) // 1000 * 1000 - delay
        for alert in table:
            if alert["until"] is not None and alert["until"] <= mark and alert["alert_id"] in state and not state.pop(alert["alert_id"])[1]:
                want.add((alert["alert_id"], "expired", alert["until"], None))
    assert late > 20 and {w[1] for w in want} == {"fired", "expired"}
    df = spark.createDataFrame(rows, "symbol string, at long, price double, action string, n int").withColumn("ts", F.timestamp_micros("at").cast("timestamp_ntz"))

    def make(s):
        known = s.sparkSession.createDataFrame([tuple(a[c] for c in ("alert_id", "symbol", "kind", "low", "high", "long", "wanted", "until")) for a in table], ALERTS.replace("expires timestamp", "until long"))
        return alerts.stream_alerts_once(s.select("symbol", "ts", "price", "action"), known.withColumn("expires", F.timestamp_micros("until")), late="2 hours", span=hour // 2)

    got = replay(df, make, arrival=F.col("n")).select("alert_id", "status", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "price").collect()
    assert len(got) == len(want) and set(map(tuple, got)) == want


def _files(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("part-*") if "_applied" not in str(p)}


def test_merge_touches_its_months_only(spark, tmp_path):
    path = str(tmp_path / "store")
    make = lambda rows: spark.createDataFrame(rows, "symbol string, ts string, close double").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    assert store.merge_batch(make([("A", "2026-01-05", 1.0), ("A", "2026-02-05", 2.0)]), 0, path, writer="w")
    before = _files(tmp_path / "store")
    assert store.merge_batch(make([("A", "2026-02-05", 3.0), ("B", "2026-02-06", 4.0)]), 1, path, writer="w")
    after = _files(tmp_path / "store")
    assert {f: t for f, t in after.items() if "2026-01" in f} == {f: t for f, t in before.items() if "2026-01" in f}
    # a batch that comes again changes nothing, not a file
    assert not store.merge_batch(make([("A", "2026-02-05", 9.0)]), 1, path, writer="w")
    assert _files(tmp_path / "store") == after
    # batch 0 of another checkpoint forgets nothing; a batch without rows is noted
    assert store.merge_batch(make([("C", "2026-03-01", 5.0)]), 0, path, writer="v")
    assert store.merge_batch(make([]), 1, path, writer="v")
    rows = sorted((r.symbol, str(r.ts.date()), r.close) for r in store.stored_bars(spark, path).collect())
    assert rows == [("A", "2026-01-05", 1.0), ("A", "2026-02-05", 3.0), ("B", "2026-02-06", 4.0), ("C", "2026-03-01", 5.0)]
    assert sorted((r.writer, r.batch, r.months) for r in store.applied(spark, path).collect()) == [("v", 0, ["2026-03"]), ("v", 1, []), ("w", 0, ["2026-01", "2026-02"]), ("w", 1, ["2026-02"])]


def test_merge_from_a_stream(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = bars(spark, 4, 70).cache()
    late = rows.filter("day(ts) = 3").withColumns({"close": F.lit(-1.0)})
    replay(rows.withColumn("n", F.month("ts")).unionByName(late.withColumn("n", F.lit(9))), lambda s: s.select("symbol", "ts", "high", "low", "close"), arrival=F.col("n"), sink=merge_bars(path, writer="w"))
    got = store.stored_bars(stream_session(spark), path)
    assert got.count() == 140 and got.filter("close = -1").count() == late.count() == got.filter("day(ts) = 3").count()
