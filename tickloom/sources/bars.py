"""Bars (open, high, low, close, volume, value, frequency) derived from the tables, and the bar store."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tickloom.operators.series import keys

BAR_SCHEMA = "symbol string, ts timestamp_ntz, open double, high double, low double, close double, volume bigint, value double, frequency bigint"
STORE_SCHEMA = (
    "instrument_id bigint, timeframe string, ts timestamp, open decimal(18,4), high decimal(18,4), low decimal(18,4), "
    "close decimal(18,4), volume bigint, value decimal(20,2), frequency int"
)
TIMEFRAMES = ("1m", "5m", "15m", "1h", "4h", "1d", "1w", "1mo")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def to_bars(ticks: DataFrame, unit: str, *, price: Column, order: Column, volume: Column, value: Column, by: Sequence[str] | None = None) -> DataFrame:
    """Aggregate ticks (by, ts), by the series' key unless told otherwise, into bars of a calendar unit; one partial and one final aggregation, no window."""
    by = keys() if by is None else by
    start = F.date_trunc(unit, "ts").cast("timestamp_ntz")
    return ticks.groupBy(*by, start.alias("ts")).agg(
        F.min_by(price, order).alias("open"),
        F.max(price).alias("high"),
        F.min(price).alias("low"),
        F.max_by(price, order).alias("close"),
        F.sum(volume).cast("bigint").alias("volume"),
        F.sum(value).alias("value"),
        F.count("*").alias("frequency"),
    )


def _line_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", F.col("l_shipdate").alias("ts"))


def _line_bars(ticks: DataFrame, by: Sequence[str]) -> DataFrame:
    return to_bars(
        ticks,
        "week",
        price=F.try_divide("l_extendedprice", "l_quantity"),
        order=F.struct("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        volume=F.col("l_quantity"),
        value=F.col("l_extendedprice"),
        by=by,
    )


def brand_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars per part brand."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    ticks = _line_ticks(spark, sf_dir)
    return _line_bars(ticks.join(part, ticks.l_partkey == part.p_partkey), ["symbol"])


def nation_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars per supplier nation, its region as sector."""
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    instruments = nations(spark, sf_dir)
    ticks = _line_ticks(spark, sf_dir)
    ticks = ticks.join(supplier, ticks.l_suppkey == supplier.s_suppkey).join(instruments, F.col("s_nationkey") == F.col("instrument_id"))
    return _line_bars(ticks, ["symbol", "sector"])


def event_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly bars per event type."""
    ticks = table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "value")
    return to_bars(ticks, "hour", price=F.col("value"), order=F.col("ts"), volume=F.lit(1), value=F.col("value"))


def nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instrument dimension: nations by their region."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("instrument_id"), F.col("n_name").alias("symbol"), F.col("r_name").alias("sector")
    )


def resample(bars: DataFrame, unit: str = "week", *, by: Sequence[str] | None = None) -> DataFrame:
    """Bars of a coarser width, labelled by its start; widths without any complete bar are left out.

    `unit` is a calendar unit (weeks begin on Monday) or a width like "4 hours" (from midnight).
    """
    by = keys() if by is None else by
    whole = bars.dropna(subset=["open", "high", "low", "close"])
    start = (F.window("ts", unit)["start"] if unit[0].isdigit() else F.date_trunc(unit, "ts")).cast("timestamp_ntz")
    return whole.groupBy(*by, start.alias("start")).agg(
        F.min_by("open", "ts").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "ts").alias("close"),
        F.sum("volume").alias("volume"),
    ).withColumnRenamed("start", "ts")


def normalise(raw: DataFrame, *, zone: str = "Asia/Jakarta") -> DataFrame:
    """A provider's frame (symbol, ts without zone in `zone`, Open.. Volume) as bars in UTC; value is close times volume, frequency unknown."""
    return raw.select(
        F.upper("symbol").alias("symbol"),
        F.to_utc_timestamp(F.col("ts").cast("timestamp"), zone).cast("timestamp_ntz").alias("ts"),
        *[F.col(c).cast("double").alias(c.lower()) for c in ("Open", "High", "Low", "Close")],
        F.col("Volume").cast("bigint").alias("volume"),
        (F.col("Close") * F.col("Volume")).cast("double").alias("value"),
        F.lit(None).cast("bigint").alias("frequency"),
    )


def to_provider_symbol(symbol: Column) -> Column:
    return F.concat(F.upper(symbol), F.lit(".JK"))


def from_provider_symbol(symbol: Column) -> Column:
    return F.regexp_replace(F.upper(symbol), r"\.JK$", "")


def stored(bars: DataFrame) -> DataFrame:
    """bars in the types of the store: prices are decimals at rest; columns that are missing are null."""
    fields = StructType.fromDDL(STORE_SCHEMA).fields
    return bars.select(*[(F.col(f.name) if f.name in bars.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields], F.date_format("ts", "yyyy-MM").alias("month"))


def write_store(bars: DataFrame, path: str) -> None:
    """Parquet by timeframe and month. Of an existing store only the months that `bars` has are replaced."""
    stored(bars).write.partitionBy("timeframe", "month").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def ingest(loads: DataFrame, stored_bars: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(bars, report) of loads (instrument_id, timeframe, ts, prices, volume, error): one instrument's failure harms no other.

    Instruments with an `error` give no bars; the report has one row per instrument: bars,
    error, status (loaded, failed or empty). Bars of the load win over stored ones.
    """
    own = Window.partitionBy("instrument_id")
    marked = loads.withColumn("_failed", F.max(F.col("error").isNotNull()).over(own))
    report = marked.groupBy("instrument_id").agg(
        F.count(F.when(~F.col("_failed") & F.col("ts").isNotNull(), 1)).alias("bars"), F.max("error").alias("error"), F.max("_failed").alias("_failed")
    )
    status = F.when(F.col("_failed"), "failed").when(F.col("bars") == 0, "empty").otherwise("loaded")
    fine = stored(marked.filter(~F.col("_failed") & F.col("ts").isNotNull())).withColumn("load_seq", F.lit(0).cast("bigint"))
    keys = ["instrument_id", "timeframe", "ts"]
    before = fine.drop("load_seq").limit(0) if stored_bars is None else stored(stored_bars)
    return upsert(before, fine, key=keys), report.select("instrument_id", "bars", "error", status.alias("status"))


def read_store(spark: SparkSession, path: str, *, timeframe: str, instruments: Sequence[int] | None = None, start: str | None = None, stop: str | None = None) -> DataFrame:
    """Bars of a timeframe (and of some instruments) with start <= ts <= stop, prices as doubles; the month predicate prunes folders."""
    if timeframe not in TIMEFRAMES:
        raise ValueError(f"unknown timeframe {timeframe!r}")
    bars = spark.read.parquet(path).filter(F.col("timeframe") == timeframe)
    if instruments is not None:
        bars = bars.filter(F.col("instrument_id").isin(list(instruments)))
    if start is not None:
        bars = bars.filter((F.col("ts") >= start) & (F.col("month") >= start[:7]))
    if stop is not None:
        bars = bars.filter((F.col("ts") <= stop) & (F.col("month") <= stop[:7]))
    return bars.withColumns({c: F.col(c).cast("double") for c in ("open", "high", "low", "close")})


def upsert(stored: DataFrame, loaded: DataFrame, *, key: Sequence[str], sequence: str = "load_seq") -> DataFrame:
    """The union of both, of rows with one key that of the latest load sequence (`stored` counts as the earliest; of one sequence the row that sorts last)."""
    both = stored.withColumn(sequence, F.lit(-1).cast("bigint")).unionByName(loaded.withColumn(sequence, F.col(sequence).cast("bigint")))
    latest = Window.partitionBy(*key).orderBy(F.desc(sequence), *[F.desc(c) for c in both.columns if c not in (*key, sequence)])
    return both.withColumn("_rank", F.row_number().over(latest)).filter("_rank = 1").drop("_rank", sequence)


def upsert_instruments(stored: DataFrame, loaded: DataFrame) -> DataFrame:
    """Match by (symbol, exchange): name, sector and is_active of the load win, other rows are inserted; `outcome` tells kept, updated or created."""
    keys = ["symbol", "exchange"]
    old = stored.select(*keys, *[F.col(c).alias(f"old_{c}") for c in ("name", "sector", "is_active")], F.lit(True).alias("was"))
    new = loaded.select(*keys, "name", "sector", "is_active", F.lit(True).alias("now"))
    met = old.join(new, keys, "full")
    pick = lambda c: F.when(F.col("now"), F.col(c)).otherwise(F.col(f"old_{c}")).alias(c)
    outcome = F.when(F.col("now").isNull(), "kept").when(F.col("was").isNull(), "created").otherwise("updated")
    return met.select(*keys, pick("name"), pick("sector"), pick("is_active"), outcome.alias("outcome"))
