"""Runs a stream over rows of a table: what arrives is written to a folder, arrival by arrival, and each arrival is taken by a query that starts from the checkpoint of the one before."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; a session of one process that names none gets a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-streams-")
    return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_session(spark: SparkSession) -> SparkSession:
    """A session of its own for streams: times in UTC, state in RocksDB. The caller's settings stay."""
    own = spark.newSession()
    for name, value in (("spark.sql.session.timeZone", "UTC"), ("spark.sql.streaming.stateStore.providerClass", ROCKSDB), ("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))):
        own.conf.set(name, value)
    return own


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, on whatever file system it lies."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def replay(rows: DataFrame, make: Callable[[DataFrame], DataFrame], *, arrival: Column, sink: Callable[[DataFrame, int], None] | None = None) -> DataFrame | None:
    """All rows that the stream make(rows) puts out in append mode, its times without zone.

    Rows come in ascending order of `arrival` (few values); those of one arrival together. `ts`,
    without zone in `rows`, is a time of UTC in the stream. With a sink, a function of a
    micro-batch and its number, nothing is returned.
    """
    spark = rows.sparkSession
    own, base = stream_session(spark), shared_folder(spark)
    marked = rows.withColumn("_arrival", arrival)
    slim = marked.drop("_arrival")
    schema = None
    for n in [r[0] for r in marked.select("_arrival").distinct().orderBy("_arrival").collect()]:
        marked.filter(F.col("_arrival") == n).select(*slim.columns).write.mode("append").parquet(f"{base}/in")
        given = own.readStream.schema(slim.schema).parquet(f"{base}/in").withColumn("ts", F.col("ts").cast("timestamp"))
        made = make(given)
        out = made.select(*[F.col(c).cast("timestamp_ntz").alias(c) if kind == "timestamp" else F.col(c) for c, kind in made.dtypes])
        schema = out.schema
        writer = out.writeStream.outputMode("append").option("checkpointLocation", f"{base}/state").trigger(availableNow=True)
        query = (writer.foreachBatch(sink) if sink else writer.format("parquet").option("path", f"{base}/out")).start()
        query.awaitTermination()
    delete(spark, f"{base}/in")
    delete(spark, f"{base}/state")
    if sink:
        return None
    return spark.createDataFrame([], slim.schema) if schema is None else spark.read.schema(schema).parquet(f"{base}/out")
