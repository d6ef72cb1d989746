"""Sharding by jump consistent hashing, in DataFrame expressions only.

A key's 64-bit state (the first 64 bits of its md5) drives a linear congruential
generator; each draw gives the next shard count at which the key would move. The shard
for n shards is the last such point below n, so going from n to n + 1 shards moves only
the rows that land in the new shard, and no ring table exists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import md5_words, quoted, repeated

# Fixed values of the published generator.
MULTIPLIER = 2862933555777941757
MASK32 = (1 << 32) - 1

#: Draws made before the exact fallback: a key needs about ln(shards) draws.
DRAWS = 64


def _next_state(hi: Column, lo: Column) -> tuple[Column, Column]:
    """state * MULTIPLIER + 1 modulo 2^64 on 32-bit halves: no product leaves a signed long, so ANSI mode holds."""
    m_hi, m_lo = MULTIPLIER >> 32, MULTIPLIER & MASK32
    m0, m1 = F.lit(m_lo & 0xFFFF), F.lit(m_lo >> 16)
    mask, half = F.lit(MASK32), F.lit(0xFFFF)

    def times_low(x: Column) -> tuple[Column, Column]:
        upper = x * m1
        total = x * m0 + F.shiftleft(upper.bitwiseAND(half), 16)
        return total, F.shiftright(upper, 16)

    low, carry = times_low(lo)
    low = low + F.lit(1)
    cross, _ = times_low(hi)
    new_hi = F.shiftright(low, 32) + carry + (lo * F.lit(m_hi)).bitwiseAND(mask) + cross.bitwiseAND(mask)
    return new_hi.bitwiseAND(mask), low.bitwiseAND(mask)


def jump_shards(key: Column, shards: int) -> Column:
    """struct(shard, grown): the key's shard among `shards`, and among `shards + 1`.

    One run of the generator gives both: they are the last points below the two counts.
    """
    if shards < 1:
        raise ValueError("shards must be positive")
    hi, lo = md5_words(key)
    zero = F.lit(0).cast("long")
    start = F.struct(hi.alias("hi"), lo.alias("lo"), zero.alias("shard"), zero.alias("grown"), zero.alias("j"))

    def step(s: Column, _: Column) -> Column:
        new_hi, new_lo = _next_state(s["hi"], s["lo"])
        draw = F.struct(new_hi.alias("hi"), new_lo.alias("lo"))
        moved = F.transform(
            F.array(draw),
            lambda d: F.struct(
                d["hi"].alias("hi"),
                d["lo"].alias("lo"),
                F.when(s["j"] < shards, s["j"]).otherwise(s["shard"]).alias("shard"),
                s["j"].alias("grown"),
                F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftright(d["hi"], 1) + 1).cast("double"))).cast("long").alias("j"),
            ),
        )[0]
        return F.when(s["j"] <= shards, moved).otherwise(s)

    state = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards + 1, DRAWS))), start, step)
    if shards + 1 > DRAWS:  # exact for the few keys that need more draws
        first = state
        state = F.transform(
            F.array(first), lambda s: F.when(s["j"] <= shards, F.aggregate(F.sequence(F.lit(DRAWS + 1), F.lit(shards + 1)), s, step)).otherwise(s)
        )[0]
    return F.transform(F.array(state), lambda s: F.struct(s["shard"].cast("int").alias("shard"), s["grown"].cast("int").alias("grown")))[0]


def assign_shards(df: DataFrame, *, key: str = "doc_id", text: str = "text", shards: int = 24, ranges: int = 1024) -> DataFrame:
    """One row per input row: the key, size, text_crc32, law, shard, slot and grown_shard.

    The key and the shard count alone decide the shard (law `key`), so rows that share a key
    share a shard. A null key is a key of its own; a null text has no bytes (size 8, crc32 0).
    Repeated rows each get a slot of their own.

    Slots are gapless in each shard without sorting a shard in one task: rows are dealt to
    `ranges` hash ranges per shard by key and text, the counts of the ranges are prefix-summed
    (at most `ranges` rows per shard), and each range numbers its own rows. Repeated rows are
    counted before they are shuffled, so one key, or one row, may hold any share of all rows.
    """
    body = F.coalesce(quoted(text), F.lit(""))
    told = df.select(
        quoted(key).alias("doc_id"),
        (F.octet_length(body).cast("long") + 8).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    ).withColumns({"jumped": jump_shards(F.col("doc_id"), shards), "part": F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(ranges)).cast("int")})
    rows = told.groupBy("doc_id", "size", "text_crc32", F.col("jumped.shard").alias("shard"), F.col("jumped.grown").alias("grown_shard"), "part").agg(F.count("*").alias("n"))
    counts = told.groupBy(F.col("jumped.shard").alias("shard"), "part").agg(F.count("*").alias("there"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "part", F.coalesce(F.sum("there").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(offsets, ["shard", "part"])
    return repeated(placed, F.col("n"), nth="nth").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("offset") + F.col("before") + F.col("nth")).cast("long").alias("slot"),
        "grown_shard",
    )


def with_shards(df: DataFrame, *, key: str = "doc_id", shards: int = 24, shard: str = "shard", grown: str = "grown_shard") -> DataFrame:
    """df with each row's shard, and its shard were there one more; nothing is shuffled.

    A null key is a key of its own, rows that share a key share a shard; texts are not looked
    at. Columns of those names are replaced, others kept. No rows in, no rows out.
    """
    jumped = jump_shards(quoted(key), shards)
    return df.withColumns({shard: jumped["shard"], grown: jumped["grown"]})


def write_shards(df: DataFrame, path: str, *, key: str = "doc_id", shards: int = 24) -> None:
    """Write the rows themselves as Parquet, one folder `shard=i` per shard."""
    df.withColumn("shard", jump_shards(quoted(key), shards)["shard"]).write.partitionBy("shard").mode("overwrite").parquet(path)
