"""A provider's price files as a Spark data source: a partition per symbol and file, filters pushed down, types told.

The provider's folder holds one CSV file per symbol and timeframe, named SYMBOL/TIMEFRAME.csv,
with the header Date,Open,High,Low,Close,Volume and times without zone in the exchange's zone.
Scans give the frame that sources.bars.normalise() takes: symbol, ts, Open, High, Low, Close,
Volume. There is no HTTP here: the folder is any path that pyarrow's file systems reach.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv, fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from tickloom.sources.bars import TIMEFRAMES

SCHEMA = "symbol string, ts timestamp_ntz, Open double, High double, Low double, Close double, Volume bigint"
_TYPES = {"Date": pa.timestamp("us"), "Open": pa.float64(), "High": pa.float64(), "Low": pa.float64(), "Close": pa.float64(), "Volume": pa.int64()}
_ARROW = pa.schema([("symbol", pa.string()), ("ts", pa.timestamp("us")), *[(c, t) for c, t in _TYPES.items() if c != "Date"]])


@dataclass
class SymbolFile(InputPartition):
    symbol: str
    path: str

    def __init__(self, symbol: str, path: str):
        super().__init__(0)
        self.symbol, self.path = symbol, path


def _file_system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class ProviderReader(DataSourceReader):
    """Symbols by `=` and `in` choose the files; bounds of ts are applied while a file is read, before rows leave the task."""

    def __init__(self, path: str, timeframe: str):
        self.path, self.timeframe = path.rstrip("/"), timeframe
        self.symbols: set[str] | None = None
        self.bounds: list[tuple[str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        compare = {GreaterThan: "greater", GreaterThanOrEqual: "greater_equal", LessThan: "less", LessThanOrEqual: "less_equal", EqualTo: "equal"}
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("symbol",) and isinstance(f, (EqualTo, In)):
                own = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.symbols = own if self.symbols is None else self.symbols & own
            elif column == ("ts",) and type(f) in compare:
                self.bounds.append((compare[type(f)], f.value))
            else:
                yield f  # Spark filters by what is not taken here

    def partitions(self) -> list[SymbolFile]:
        files, root = _file_system(self.path)
        found = []
        for symbol in fs_names(files, root, fs.FileType.Directory):
            if self.symbols is None or symbol in self.symbols:
                if f"{self.timeframe}.csv" in fs_names(files, f"{root}/{symbol}", fs.FileType.File):
                    found.append(SymbolFile(symbol, f"{self.path}/{symbol}/{self.timeframe}.csv"))
        return found

    def read(self, partition: SymbolFile) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, SymbolFile):  # without a file Spark asks for one partition all the same
            return
        files, at = _file_system(partition.path)
        with files.open_input_stream(at) as stream:
            for batch in csv.open_csv(stream, read_options=csv.ReadOptions(use_threads=False), convert_options=csv.ConvertOptions(column_types=_TYPES, include_columns=list(_TYPES), strings_can_be_null=True)):
                for name, value in self.bounds:
                    batch = batch.filter(getattr(pc, name)(batch["Date"], pa.scalar(value, pa.timestamp("us"))))
                yield pa.record_batch([pa.array([partition.symbol] * len(batch), pa.string()), *[batch[c] for c in _TYPES]], schema=_ARROW)


def fs_names(files: fs.FileSystem, path: str, kind: fs.FileType) -> list[str]:
    """The names of what lies in a folder, sorted; none if there is no such folder."""
    return sorted(i.base_name for i in files.get_file_info(fs.FileSelector(path, allow_not_found=True)) if i.type == kind)


class ProviderSource(DataSource):
    """spark.read.format("provider").option("timeframe", "1d").load(folder); see scan()."""

    @classmethod
    def name(cls) -> str:
        return "provider"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ProviderReader:
        timeframe = self.options.get("timeframe", "1d")
        if timeframe not in TIMEFRAMES:
            raise ValueError(f"unknown timeframe {timeframe!r}")
        return ProviderReader(self.options["path"], timeframe)


def scan(spark: SparkSession, folder: str, timeframe: str = "1d") -> DataFrame:
    """The folder's bars of a timeframe as normalise() takes them; a folder without any gives the same columns and no rows.

    Filters on symbol choose the files, bounds on ts are applied in the tasks. Spark keeps what a
    source planned for a frame until a query pushes filters again, so the frame has one that
    always holds: no query can see the files that another one chose.
    """
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ProviderSource)
    return spark.read.format("provider").option("timeframe", timeframe).load(folder).filter("symbol IS NOT NULL")
