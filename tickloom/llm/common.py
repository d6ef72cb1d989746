"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

WORD_GAP = r"[^\x20\x09-\x0D]+"
#: Shuffle files go when the job that wrote them has ended, not when the driver next collects garbage.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the folder of spark.checkpoint.dir.

    A session of one process (master local) that names none gets a temporary folder; on a
    cluster a folder that all executors share must be named. The shuffle files of the job are
    deleted once the checkpoint is written: nothing reads them again.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    before = spark.conf.get(FREE_SHUFFLES, "false")
    spark.conf.set(FREE_SHUFFLES, "true")
    try:
        once = df.select("*")  # the setting is read when a frame is made
    finally:
        spark.conf.set(FREE_SHUFFLES, before)
    return once.checkpoint(eager=True)


def quoted(name: str) -> Column:
    """The column of that name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(df: DataFrame, name: str) -> str:
    """The name, or the name with underscores after it, that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def packed(columns: Sequence[str]) -> Column:
    """The columns as one struct whose fields are named by their place, so that any column names will do."""
    return F.struct(*[quoted(c).alias(f"c{i}") for i, c in enumerate(columns)])


def unpacked(columns: Sequence[str], row: str = "row") -> list[Column]:
    """The columns of packed(), under their names again."""
    return [F.col(row)[f"c{i}"].alias(c) for i, c in enumerate(columns)]


def text_within(df: DataFrame, columns: Sequence[str], text: str, row: str = "row") -> tuple[Callable[[pa.RecordBatch], pa.Array], list[Column]]:
    """How an Arrow batch of packed() rows tells the texts, and the columns to select beside the row for that.

    Where the row holds the text as a string there are none, so that texts go to Python once.
    """
    if text in columns and df.schema[text].dataType == StringType():
        place = list(columns).index(text)
        return lambda batch: batch.column(row).field(place), []
    return lambda batch: batch.column("text_"), [quoted(text).cast("string").alias("text_")]


def schema_with(df: DataFrame, kept: str, fields: str) -> StructType:
    """A schema of df's column `kept` followed by the fields of a DDL string."""
    return StructType([df.schema[kept], *StructType.fromDDL(fields).fields])


def repeated(rows: DataFrame, times: Column, *, nth: str = "nth", at_once: int = 1 << 16) -> DataFrame:
    """Each row so many times (none for 0), numbered from 0 in `nth`; arrays hold `at_once` numbers at most, however large `times` is."""
    first = F.when(times > 0, F.sequence(F.lit(0).cast("long"), (times - 1).cast("long"), F.lit(at_once).cast("long")))
    rows = rows.withColumn("lo_", F.explode(first)).withColumn("hi_", F.least(F.col("lo_") + at_once, times) - 1)
    return rows.withColumn(nth, F.explode(F.sequence("lo_", "hi_"))).drop("lo_", "hi_")


def md5_words(key: Column) -> tuple[Column, Column]:
    """The first two 32-bit words of md5(key) as longs; a null key counts as the empty string."""
    hexed = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(hexed, 1, 8), 16, 10).cast("long"), F.conv(F.substring(hexed, 9, 8), 16, 10).cast("long"))


def crc32_mod(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo n (null for a null key)."""
    return F.crc32(key.cast("string").cast("binary")) % F.lit(n)


def word_count(text: Column) -> Column:
    """Number of runs of other than ASCII white space; null counts none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_GAP)), F.lit(0)).cast("long")
