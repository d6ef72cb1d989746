"""Operators for series too long for one task: time is cut in ranges, a range of a series is one task's work.

What a range needs from those before it is a small summary: its last value for as-of joins, a
linear map for exponential means. The summaries of a series, as many as it has ranges, are
scanned in order and handed back to the ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tickloom.operators.recurrence import exponential
from tickloom.operators.series import keys, micros, so_far

RANGES = 256


def _number(df: DataFrame, on: str) -> Column:
    """A column that orders rows as a long: microseconds of a time."""
    kind = dict(df.dtypes)[on]
    if kind == "timestamp_ntz":
        return micros(on)
    return F.unix_micros(on) if kind == "timestamp" else F.unix_date(on).cast("long") if kind == "date" else F.col(on).cast("long")


def time_range(df: DataFrame, on: str = "ts", ranges: int = RANGES, *, like: DataFrame | None = None) -> Column:
    """The number of the range that a row lies in, from 0: equal widths between the least and the greatest time of `like` (by default df); what lies outside belongs to the first or last range. Null times are in range 0."""
    given = df if like is None else like
    lo, hi = given.agg(F.min(_number(given, on)), F.max(_number(given, on))).first()
    lo, width = (0, 1) if lo is None else (lo, -(-(hi - lo + 1) // ranges))
    cut = F.floor((_number(df, on) - F.lit(lo)) / F.lit(width))
    return F.coalesce(F.least(F.greatest(cut, F.lit(0)), F.lit(ranges - 1)), F.lit(0)).cast("int")


def as_of(left: DataFrame, right: DataFrame, *, by: Sequence[str], on: str, values: Sequence[str], ranges: int = RANGES) -> DataFrame:
    """left with the values of the latest right row at or before its time; null where there is none. No range join.

    Both sides meet in one sort of their union within each range of a series; a row before the
    range's first right row takes the last value of the ranges before. Right rows of one time
    count in order of their values; right rows without a time don't count.
    """
    right = right.filter(F.col(on).isNotNull())
    fields = [F.col(v).alias(v) for v in values]
    kind = right.select(F.struct(*fields)).schema[0].dataType
    l = left.select(*by, on, F.struct(*left.columns).alias("_left"), F.lit(None).cast(kind).alias("_right"), F.lit(1).alias("_side"), time_range(left, on, ranges, like=right).alias("_range"))
    r = right.select(*by, on, F.lit(None).cast(l.schema["_left"].dataType).alias("_left"), F.struct(*fields).alias("_right"), F.lit(0).alias("_side"), time_range(right, on, ranges, like=right).alias("_range"))
    both = l.unionByName(r)
    inside = so_far(Window.partitionBy(*by, "_range").orderBy(on, "_side", "_right"))
    met = both.withColumn("_last", F.last("_right", ignorenulls=True).over(inside)).filter("_side = 1")
    ends = both.groupBy(*by, "_range").agg(F.max(F.when(F.col("_side") == 0, F.struct(on, "_right"))).alias("_end"))
    before = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(c).alias(f"_by{i}") for i, c in enumerate(by)], F.col("_range").alias("_at"), F.last("_end", ignorenulls=True).over(before)["_right"].alias("_carried"))
    same = F.col("_range") == F.col("_at")
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_by{i}"))
    out = met.join(carried, same, "left")
    # a left row without a time matches nothing
    value = F.when(F.col(on).isNotNull(), F.coalesce("_last", "_carried"))
    return out.select(*[F.col("_left")[c].alias(c) for c in left.columns], *[value[v].alias(v) for v in values])


def _summary(x: np.ndarray, span: int) -> tuple[float, float, float, float, float]:
    """Nulls before the first value, that value, and a and b of the map from the mean at it to the mean at the end, and nulls after the last value. Without values: their number, NaN, NaN, NaN, it again."""
    there = np.flatnonzero(~np.isnan(x))
    if not len(there):
        return len(x), np.nan, np.nan, np.nan, len(x)
    rest = x[there[0] + 1 :]
    a = exponential(np.concatenate([[1.0], np.where(np.isnan(rest), np.nan, 0.0)]), span)[-1]
    b = exponential(np.concatenate([[0.0], rest]), span)[-1]
    return there[0], x[there[0]], a, b, len(x) - 1 - there[-1]


def _joined(mean: float, nulls: float, first: float, span: int) -> float:
    """The mean at a value that so many nulls separate from the mean before; without a mean before it is the value."""
    if np.isnan(mean):
        return first
    alpha = 2 / (span + 1)
    weight = (1 - alpha) ** (nulls + 1)
    return (weight * mean + alpha * first) / (weight + alpha)


def add_ema(bars: DataFrame, *spans: int, price: str = "close", ranges: int = RANGES) -> DataFrame:
    """bars with ema{span} for each span, as the fold has it (nulls keep the mean while its weight decays), each series folded range by range.

    A range's mean at its end is a linear function of the mean at its first value; these maps
    are composed in order, so every range knows where its mean starts, and is folded once more.
    """
    of = list(keys())
    rows = bars.withColumn("_range", time_range(bars, ranges=ranges))
    told = ("lead", "first", "a", "b", "trail")
    fields = [StructField(f"{n}{s}", DoubleType()) for s in spans for n in told]
    key_fields = [bars.schema[k] for k in of]
    number = lambda t: t[price].cast(pa.float64()).to_numpy()

    def summarise(table: pa.Table) -> pa.Table:
        table = table.sort_by("ts")
        made = [v for s in spans for v in _summary(number(table), s)]
        return pa.table([*[table[k].slice(0, 1) for k in [*of, "_range"]], *[pa.array([float(v)]) for v in made]], [*of, "_range", *[f.name for f in fields]])

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("_range")
        out = {}
        for s in spans:
            lead, first, a, b, trail = (table[f"{n}{s}"].to_numpy() for n in told)
            mean, nulls = np.nan, 0.0
            means, gaps = [], []
            for i in range(len(table)):
                means.append(mean)
                gaps.append(nulls)
                if np.isnan(first[i]):
                    nulls += lead[i]
                else:
                    mean, nulls = a[i] * _joined(mean, nulls + lead[i], first[i], s) + b[i], trail[i]
            out |= {f"mean{s}": pa.array(means), f"gap{s}": pa.array(gaps)}
        return pa.table([*[table[k] for k in [*of, "_range"]], *out.values()], [*of, "_range", *out])

    started = [StructField(f"{n}{s}", DoubleType()) for s in spans for n in ("mean", "gap")]
    at = StructField("_range", rows.schema["_range"].dataType)
    ends = rows.select(*of, "_range", "ts", price).groupBy(*of, "_range").applyInArrow(summarise, StructType([*key_fields, at, *fields]))
    starts = ends.groupBy(*of).applyInArrow(scan, StructType([*key_fields, at, *started]))

    def finish(table: pa.Table, start: pa.Table) -> pa.Table:
        table = table.sort_by("ts")
        x = number(table)
        there = np.flatnonzero(~np.isnan(x))
        made = []
        for s in spans:
            mean, gap = start[f"mean{s}"][0].as_py(), start[f"gap{s}"][0].as_py()
            mean = np.nan if mean is None else mean
            out = np.full(len(x), mean)
            if len(there):
                joined = _joined(mean, gap + there[0], x[there[0]], s)
                out[there[0] :] = exponential(np.concatenate([[joined], x[there[0] + 1 :]]), s)
            made.append(pa.array(out, from_pandas=True))
        kept = [c for c in table.column_names if c != "_range"]
        return pa.table([*[table[c] for c in kept], *made], [*kept, *[f"ema{s}" for s in spans]])

    schema = StructType([*bars.schema.fields, *[StructField(f"ema{s}", DoubleType()) for s in spans]])
    return rows.groupBy(*of, "_range").cogroup(starts.groupBy(*of, "_range")).applyInArrow(finish, schema)
