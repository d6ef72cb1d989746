"""Streams over files give what the batch gives."""

from pyspark.sql import functions as F

from tickloom.streaming import bars as stream

SCHEMA = "symbol string, ts timestamp, price double, volume long"


def ticks(spark, tmp_path):
    rows = [("A", f"2026-01-05 {h:02d}:{m:02d}:00", float(10 * h + m), 1) for h in range(4) for m in range(0, 60, 10)]
    spark.createDataFrame(rows, "symbol string, ts string, price double, volume int").withColumn("ts", F.to_timestamp("ts")).select("symbol", "ts", "price", F.col("volume").cast("long")).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))


def run(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name)


def test_bars(spark, tmp_path):
    out = run(stream.stream_bars(ticks(spark, tmp_path)), "bars_out", "complete").orderBy("ts").collect()
    assert [(r.open, r.high, r.low, r.close, r.volume) for r in out] == [(10.0 * h, 10 * h + 50.0, 10.0 * h, 10 * h + 50.0, 6) for h in range(4)]


def test_ema(spark, tmp_path):
    source = ticks(spark, tmp_path).withColumn("close", F.col("price"))
    out = run(stream.stream_ema(source, 3), "ema_out", "append").orderBy("ts").collect()
    value = None
    for r, price in zip(out, [10 * h + m for h in range(4) for m in range(0, 60, 10)]):
        value = price if value is None else 0.5 * value + 0.5 * price
        assert abs(r.ema - value) < 1e-9


def test_alerts(spark, tmp_path):
    alerts = spark.createDataFrame([(1, "A", "price_above", 75.0), (2, "A", "price_below", 5.0)], "alert_id int, symbol string, kind string, level double")
    out = run(stream.stream_alerts(ticks(spark, tmp_path), alerts), "alerts_out", "append").collect()
    assert sorted((r.alert_id, r.price) for r in out) == [(1, 80.0), (2, 0.0)]
