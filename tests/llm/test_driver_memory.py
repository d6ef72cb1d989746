"""What the pipeline costs the driver: rounds of the components, and copies of the training rows."""

import numpy as np
import pyarrow as pa

from tickloom.llm import components, quality


def linked(spark, monkeypatch, pairs):
    """{node: component}, and how many tables were checkpointed."""
    made = []
    monkeypatch.setattr(components, "materialize", lambda df, f=components.materialize: made.append(1) or f(df))
    df = spark.createDataFrame(pairs, "a long, b long")
    return {r.node: r.component for r in components.connected_components(df).collect()}, len(made)


def test_stars_take_no_round(spark, monkeypatch):
    pairs = [(100 * k, 100 * k + i) for k in range(5) for i in range(1, 20)] + [(507, 503), (503, 507), (503, 503), (None, 503)]
    got, made = linked(spark, monkeypatch, pairs)
    assert got == {x: x // 100 * 100 for k in range(5) for x in range(100 * k, 100 * k + 20)} | {507: 503, 503: 503}
    assert made == 1


def test_components_of_any_links(spark, monkeypatch):
    rng = np.random.default_rng(3)
    chain = [(i, i + 1) for i in range(1000, 1040)]
    wheel = [(5000, int(x)) for x in range(4900, 4950)]  # the hub is the largest
    pairs = chain + wheel + [tuple(map(int, rng.integers(0, 300, 2))) for _ in range(200)]
    least = {x: x for p in pairs for x in p if p[0] != p[1]}
    for _ in least:
        for a, b in pairs:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    assert linked(spark, monkeypatch, pairs)[0] == least
    assert linked(spark, monkeypatch, [])[0] == {}


def test_training_rows_are_held_once(spark, monkeypatch):
    rows = [(i, " ".join(f"w{(i * 31 + j * j) % 4999}" for j in range(300)), i % 2) for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    held, back = pa.default_memory_pool(), {}
    pool = pa.proxy_memory_pool(held)

    def fit(words, stats, labels, **options):
        back.update(words=sum(len(i) + len(v) for i, v in words), labels=list(labels), first=words[0][0].tolist(), bytes=sum(i.nbytes + v.nbytes for i, v in words) + stats.nbytes)

    monkeypatch.setattr(quality, "fit", fit)
    pa.set_memory_pool(pool)
    try:
        quality.train(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    finally:
        pa.set_memory_pool(held)
    by_key = sorted(rows, key=lambda r: str(r[0]))
    assert back["labels"] == [r[2] for r in by_key]
    assert back["first"] == next(iter(quality.features(pa.array([by_key[0][1]]))))[0].tolist()
    assert pool.max_memory() < 1.5 * back["bytes"]
