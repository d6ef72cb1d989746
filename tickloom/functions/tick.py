"""Tick sizes of the exchange and rounding to them, on decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Price below which a tick size holds.
BANDS = ((200, 1), (500, 2), (2000, 5), (5000, 10))
LARGEST_TICK = 25


def tick_size(price: Column) -> Column:
    size = F.when(F.lit(False), 0)
    for below, tick in BANDS:
        size = size.when(price < below, tick)
    return size.otherwise(LARGEST_TICK).cast("int")


def round_to_tick(price: Column, how: str = "nearest") -> Column:
    """The price on the grid of its own tick size: down, up or nearest (halves up); null for prices not above 0."""
    if how not in ("down", "up", "nearest"):
        raise ValueError(f"unknown rounding {how!r}")
    p = price.cast("decimal(18,4)")
    tick = tick_size(p).cast("decimal(18,4)")
    down = p - F.pmod(p, tick)
    if how == "up":
        down = F.when(F.pmod(p, tick) > 0, down + tick).otherwise(down)
    elif how == "nearest":
        down = F.when(F.pmod(p, tick) * 2 >= tick, down + tick).otherwise(down)
    return F.when(p > 0, down).cast("decimal(18,4)")
