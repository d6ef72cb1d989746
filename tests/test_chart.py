"""Chart patterns against an own loop over swings, and drawn ones."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import chart


def drawn(spark, corners, symbol="X"):
    """Bars along straight lines between (bar, price) corners, a narrow range about them."""
    at = np.arange(corners[0][0], corners[-1][0] + 1)
    close = np.interp(at, [c[0] for c in corners], [c[1] for c in corners])
    frame = pd.DataFrame({"symbol": symbol, "ts": pd.date_range("2025-01-01", periods=len(at)), "open": close, "high": close + 0.1, "low": close - 0.1, "close": close, "volume": 1})
    return spark.createDataFrame(frame).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


CASES = {
    "head_and_shoulders": [(0, 80), (10, 100), (20, 90), (30, 120), (40, 91), (50, 101), (60, 80)],
    "inverse_head_and_shoulders": [(0, 120), (10, 100), (20, 110), (30, 80), (40, 109), (50, 99), (60, 120)],
    "ascending_triangle": [(0, 60), (10, 100), (20, 70), (30, 100), (40, 80), (50, 100), (60, 90), (70, 99)],
    "descending_triangle": [(0, 140), (10, 100), (20, 130), (30, 100), (40, 120), (50, 100), (60, 110), (70, 101)],
    "symmetrical_triangle": [(0, 60), (10, 130), (20, 70), (30, 120), (40, 80), (50, 110), (60, 90), (70, 99)],
    "rising_wedge": [(0, 60), (10, 100), (20, 80), (30, 110), (40, 98), (50, 120), (60, 115), (70, 118)],
    "falling_wedge": [(0, 60), (10, 140), (20, 90), (30, 122), (40, 84), (50, 104), (60, 78), (70, 82)],
}


@pytest.mark.parametrize("name", CASES)
def test_drawn(spark, name):
    found = {r.pattern: r for r in chart.chart_patterns(drawn(spark, CASES[name])).collect()}
    assert name in found, found
    r = found[name]
    assert (r.confirmed - r.ts).days == 5
    if name == "head_and_shoulders":
        # the neckline through (20, 89.9) and (40, 90.9) is at 91.4 under the last shoulder, and 29.7 below the head
        assert (round(r.breakout_level, 6), round(r.measured_target, 6)) == (91.4, 61.7)
    if name == "ascending_triangle":
        assert abs(r.breakout_level - 100.1) < 1e-6 and r.measured_target > r.breakout_level


def test_noise_has_no_rule_broken(spark):
    """Every pattern found in walks satisfies its definition, and every window of swings that does is found."""
    rng = np.random.default_rng(3)
    frames = []
    for s in "ABCDEF":
        close = 500 * np.exp(np.cumsum(rng.normal(0, 0.02, 600)))
        frames.append(pd.DataFrame({"symbol": s, "ts": pd.date_range("2020-01-01", periods=600), "high": close * 1.004, "low": close * 0.996, "open": close, "close": close, "volume": 1}))
    bars = spark.createDataFrame(pd.concat(frames)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    swings = chart.swing_sequence(bars).toPandas().sort_values(["symbol", "n", "kind"])
    got = {(r.symbol, r.ts, r.pattern): (r.breakout_level, r.measured_target) for r in chart.chart_patterns(bars).collect()}
    want = {}
    for s, own in swings.groupby("symbol"):
        rows = list(own.itertuples())
        for i in range(len(rows)):
            if i >= 4:
                a, b, c, d, e = rows[i - 4 : i + 1]
                if [x.kind for x in (a, b, c, d, e)] in (["high", "low"] * 2 + ["high"], ["low", "high"] * 2 + ["low"]) and abs(e.price / a.price - 1) <= 0.05:
                    neck = np.poly1d(np.polyfit([b.n, d.n], [b.price, d.price], 1))
                    height = c.price - neck(c.n)
                    if c.kind == "high" and c.price > max(a.price, e.price) and height > 0:
                        want[s, e.ts, "head_and_shoulders"] = neck(e.n), neck(e.n) - height
                    if c.kind == "low" and c.price < min(a.price, e.price) and height < 0:
                        want[s, e.ts, "inverse_head_and_shoulders"] = neck(e.n), neck(e.n) - height
            if i >= 5:
                six = rows[i - 5 : i + 1]
                high, low = ([x for x in six if x.kind == k] for k in ("high", "low"))
                if len(high) != 3:
                    continue
                top, bottom = (np.poly1d(np.polyfit([x.n for x in p], [x.price for x in p], 1)) for p in (high, low))
                way = [0 if abs(w) <= 0.0005 else int(np.sign(w)) for w in (line[1] / np.mean([x.price for x in p]) for line, p in ((top, high), (bottom, low)))]
                first, last = six[0].n, six[-1].n
                name = {(0, 1): "ascending_triangle", (-1, 0): "descending_triangle", (-1, 1): "symmetrical_triangle", (1, 1): "rising_wedge", (-1, -1): "falling_wedge"}.get(tuple(way))
                width = top(first) - bottom(first)
                if name and 0 < top(last) - bottom(last) < width:
                    below = name in ("descending_triangle", "rising_wedge")
                    want[s, six[-1].ts, name] = (bottom(last), bottom(last) - width) if below else (top(last), top(last) + width)
    assert got.keys() == want.keys() and len(want) > 10
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-6)
