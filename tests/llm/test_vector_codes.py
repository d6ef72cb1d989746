"""Vector codes against Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tickloom.llm import vectorcodes as vc

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, parts, entries, rounds, scale):
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    if not kept:
        return [], None
    width = max(parts, -(-max(len(r[1]) for r in kept) // parts) * parts)
    whole = lambda v: [math.floor(x * scale) for x in v] + [0] * (width - len(v))
    n = width // parts
    cut = lambda v: [whole(v)[p * n : (p + 1) * n] for p in range(parts)]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(r[1])[p] for r in first] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for r in kept:
                groups.setdefault(near(cut(r[1])[p], books[p])[1], []).append(cut(r[1])[p])
            books[p] = [[sum(c) // len(groups[j]) for c in zip(*groups[j])] if j in groups else e for j, e in enumerate(books[p])]
    out, totals = [], {}
    for r in kept:
        met = [near(x, b) for x, b in zip(cut(r[1]), books)]
        error = sum(d for d, _ in met)
        totals.setdefault(r[2], []).append(error)
        out.append((r[0], "".join(f"{j:02x}" for _, j in met), error, r[2]))
    fits = lambda x: x if x < 2**63 else None
    label = {k: fits(sum(v)) if max(v) < 2**63 else None for k, v in totals.items()}
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, fits(e), label[k], sha) for i, c, e, k in out), key=repr), sha


def coded(spark, rows, schema=SCHEMA, **options):
    out = vc.compress(spark.createDataFrame(rows, schema).repartition(3), **options).collect()
    return sorted(((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in out), key=repr)


def f32(x):
    return float(np.float32(x))


def made(n, seed, width=16, spread=1.0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, spread) for _ in range(width)] for _ in range(7)]
    rows = [(i, [f32(x + rng.gauss(0, spread / 10)) for x in rng.choice(centres)], rng.choice([None, 1, 1, 1, 2])) for i in range(n)]
    rng.shuffle(rows)
    return rows


OPTIONS = dict(parts=4, entries=8, rounds=3, scale=1024)


@pytest.mark.parametrize("seed", [1, 2])
def test_brute_force(spark, seed):
    rows = made(150, seed)
    assert coded(spark, rows, **OPTIONS) == brute(rows, **OPTIONS)[0]


def test_ties_and_near_ties(spark):
    """Small integers with many equal distances, repeated rows and entries, unused entries."""
    rng = random.Random(5)
    rows = [(i // 2, [rng.choice([-2.0, -1.0, 0.0, 1.0]) / 1024 for _ in range(8)], None) for i in range(120)] * 2
    assert coded(spark, rows, **OPTIONS) == brute(rows, **OPTIONS)[0]


def test_edges(spark):
    """Null and non-finite components, null ids and labels, unlike lengths, empty vectors, clashing columns, fewer rows than entries, none."""
    rows = [(1, None, 1), (2, [1.0, None, 2.0, 3.0], 1), (3, [float("nan")] * 4, 1), (4, [float("inf")] + [0.0] * 3, 1), (5, [], None), (6, [0.5, -0.5], None), (7, [f32(-0.0001)] * 5, 2), (None, [1.0, 2.0, 3.0, 4.0], 2), (None, [1.0, 2.0, 3.0, 4.0], None), (9, [1.0] * 4, 2)]
    assert coded(spark, rows, **OPTIONS) == brute(rows, **OPTIONS)[0]
    wide = [(*r, "x", 1, [2]) for r in rows]
    assert coded(spark, wide, SCHEMA + ", code string, error int, v array<int>", **OPTIONS) == brute(rows, **OPTIONS)[0]
    assert coded(spark, [], **OPTIONS) == [] and coded(spark, rows[:4], **OPTIONS) == []


@pytest.mark.parametrize("large", [1e5, 1e9, 3e38])
def test_large_components(spark, large):
    """Beyond int64 distances are still exact; a sum beyond a long is null."""
    rng = random.Random(7)
    rows = made(60, 6, width=8) + [(100 + i, [f32(rng.choice([1, large]) * rng.gauss(0, 1)) if large < 1e30 or rng.random() < 0.5 else f32(large) for _ in range(8)], 3) for i in range(20)]
    rows += [(-1, [f32(large)] * 8, 4)]
    assert coded(spark, rows, **OPTIONS) == brute(rows, **OPTIONS)[0]


def test_many_labels(spark, monkeypatch):
    monkeypatch.setattr(vc, "FEW_LABELS", 1)
    rows = made(80, 8)
    assert coded(spark, rows, **OPTIONS) == brute(rows, **OPTIONS)[0]


def test_screen_holds_the_nearest():
    """Rows between two entries whose scores float32 cannot tell apart."""
    rng = np.random.default_rng(1)
    entries = rng.integers(-(1 << 23), 1 << 23, (64, 16))
    x = (entries[rng.integers(0, 64, 4000)] + entries[rng.integers(0, 64, 4000)]) // 2 + rng.integers(-1, 2, (4000, 16))
    index, distance = vc.nearest(x, entries)
    exact = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
    assert (index == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_decode(spark):
    rows = made(100, 9)
    df = spark.createDataFrame(rows, SCHEMA)
    books = vc.fit(df, **OPTIONS)
    told = {r.vec_id: (r.code, r.error) for r in vc.encode(df, books).collect()}
    for (i, v, _), back in zip(rows, vc.decode([told[r[0]][0] for r in rows], books)):
        assert round(float((((np.floor(np.array(v) * 1024) / 1024 - back) * 1024) ** 2).sum())) == told[i][1]
