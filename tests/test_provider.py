"""The provider's files as a data source."""

import pytest
from pyspark.sql import functions as F

from tickloom.sources import bars as src
from tickloom.sources import provider


@pytest.fixture
def folder(spark, tmp_path):
    for symbol, days in (("AAA", 4), ("BBB", 3), ("CCC", 2)):
        (tmp_path / symbol).mkdir()
        rows = [f"2026-01-{d:02d} 09:00:00,{d},{d + 2},{d - 1},{d + 1},{'' if d == 2 else d * 100}" for d in range(1, days + 1)]
        (tmp_path / symbol / "1d.csv").write_text("\n".join(["Date,Open,High,Low,Close,Volume", *rows]) + "\n")
    (tmp_path / "DDD").mkdir()
    # read only if a query that leaves this symbol out reads it all the same
    (tmp_path / "BAD").mkdir()
    (tmp_path / "BAD" / "1d.csv").write_text("Date,Open,High,Low,Close,Volume\nnot a date,1,1,1,1,1\n")
    return str(tmp_path)


def test_only_the_asked_symbols_are_read(spark, folder):
    df = provider.scan(spark, folder, timeframe="1d")
    assert df.filter(F.col("symbol").isin("AAA", "BBB")).count() == 7
    assert df.filter("symbol = 'CCC'").rdd.getNumPartitions() == 1
    # the same frame without the filter reads every file again, the broken one too
    with pytest.raises(Exception, match="not a date"):
        df.count()
    assert df.filter("symbol = 'AAA'").count() == 4


def test_times_are_filtered_in_the_scan(spark, folder):
    df = provider.scan(spark, folder).filter("symbol = 'AAA' AND ts >= timestamp_ntz '2026-01-02 00:00:00' AND ts < timestamp_ntz '2026-01-04 00:00:00'")
    assert [(r.ts.day, r.Close, r.Volume) for r in df.orderBy("ts").collect()] == [(2, 3.0, None), (3, 4.0, 300)]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "2026-01-04" not in plan.split("BatchScan")[0]  # no Filter above the scan


def test_reader_plans_by_filters():
    from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull

    reader = provider.ProviderReader("/nowhere", "1d")
    rest = list(reader.pushFilters([In(("symbol",), ("A", "B")), EqualTo(("symbol",), "B"), GreaterThan(("ts",), 1), GreaterThan(("Close",), 1.0), IsNotNull(("symbol",))]))
    assert reader.symbols == {"B"} and reader.bounds == [("greater", 1)] and len(rest) == 2
    assert reader.partitions() == []


def test_empty_and_unknown(spark, folder):
    empty = provider.scan(spark, folder, timeframe="1w")
    assert empty.count() == 0 and empty.schema.simpleString() == provider.scan(spark, folder).schema.simpleString()
    with pytest.raises(Exception, match="unknown timeframe"):
        provider.scan(spark, folder, timeframe="2y").count()


def test_normalised(spark, folder):
    rows = src.normalise(provider.scan(spark, folder).filter("symbol = 'BBB'")).orderBy("ts").collect()
    assert [(r.symbol, r.ts.hour, r.close, r.value) for r in rows] == [("BBB", 2, 2.0, 200.0), ("BBB", 2, 3.0, None), ("BBB", 2, 4.0, 1200.0)]
