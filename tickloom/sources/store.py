"""A bar store that streams merge into: Parquet by month, and a log of the batches that are in it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.operators.series import keys
from tickloom.sources.bars import upsert

#: The log's folder; readers of the store pass over names that begin with an underscore.
LOG = "_applied"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def applied(spark: SparkSession, path: str) -> DataFrame:
    """(writer, batch, months) of the batches that the store holds."""
    schema = "writer string, batch bigint, months array<string>"
    return spark.read.schema(schema).parquet(f"{path}/{LOG}") if _exists(spark, f"{path}/{LOG}") else spark.createDataFrame([], schema)


def stored_bars(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("month")


def merge_batch(batch: DataFrame, number: int, path: str, *, writer: str, key: Sequence[str] | None = None) -> bool:
    """Merge a micro-batch's bars into the store at `path`; False if the log says it is in already.

    Bars of the batch win over stored ones of the same key (by default the series' key and ts). Only the months that the batch
    has are read and written, each replaced as a whole when the job commits; other months keep
    their files. `writer` names the stream: its batches are numbered by its checkpoint, so a
    stream that starts afresh takes another name, and what others have merged stays. If a run
    ends between the bars and the log, the batch is merged again, to the same bars.
    """
    spark = batch.sparkSession
    if not applied(spark, path).filter((F.col("writer") == writer) & (F.col("batch") == number)).isEmpty():
        return False
    by = [*keys(), "ts"] if key is None else list(key)
    marked = batch.withColumn("month", F.date_format("ts", "yyyy-MM"))
    months = sorted(r[0] for r in marked.select("month").distinct().collect())  # as many as the batch spans
    if months:
        load = marked.withColumn("load_seq", F.lit(number))
        known = spark.read.schema(marked.schema).parquet(path).filter(F.col("month").isin(months)) if _exists(spark, path) else marked.limit(0)
        merged = upsert(known.select(*marked.columns), load, key=[*by, "month"])
        merged.write.partitionBy("month").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
    spark.createDataFrame([(writer, number, months)], "writer string, batch bigint, months array<string>").coalesce(1).write.mode("append").parquet(f"{path}/{LOG}")
    return True
