"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import materialize, md5_words, packed, quoted, repeated, unpacked, word_count

#: Ranges of the exponential key in each doubling of it. The key is exponentially distributed
#: whatever the weights are, so its logarithm is spread over several doublings and one range
#: holds at most about a thousandth of a source.
RANGES = 256


def quality_weight(text: Column) -> Column:
    """0.1 to 1: lower the larger the share of characters that are neither letters, white space nor plain punctuation."""
    odd = F.regexp_count(text, F.lit(r"[^\p{L}\p{M}\s.,;:!?'\"()-]"))
    return F.coalesce(F.greatest(F.lit(0.1), 1 - 4 * odd / F.greatest(F.char_length(text), F.lit(1))), F.lit(0.1))


def exponential_key(key: Column, weight: Column, seed: int = 0) -> Column:
    """-ln(u) / weight, u uniform in (0, 1) from 52 bits of md5(seed:key): the smallest keys are a weighted sample without replacement."""
    hi, lo = md5_words(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    u = ((hi * F.lit(1 << 20) + F.shiftright(lo, 12)).cast("double") + 0.5) / float(1 << 52)
    return -F.log(u) / weight


def source_targets(sizes: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size) -> also target: words to take from each source.

    Sources by code point, null last, take the weights in turn and share `share` times all
    words; a target stops at `most` times its source's size and the excess goes to the others
    by weight until none is above. That fixed point is found at once: sorted by cap per weight,
    a source is full if its cap per weight is at most what is left per weight when all before
    it are full. One row per source: the number of sources, not of documents, meets here.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "utf-8"))
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn.cast("int") + 1)
    everything = Window.partitionBy(F.lit(0))
    rows = sizes.select("source", "source_size", weight.alias("weight")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    rows = rows.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    order = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.encode("source", "utf-8"))
    rows = rows.withColumn("capped", F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    rows = rows.withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
    rows = rows.withColumn("level", (F.col("total") - F.col("capped")) / F.col("rest"))
    rows = rows.withColumn("open", F.col("cap") / F.col("weight") > F.col("level"))
    # the first open source in that order sets the level of all open ones; it is the highest, as later levels count open ones as full
    rows = rows.withColumn("level", F.max(F.when(F.col("open"), F.col("level"))).over(everything))
    target = F.when(F.col("open"), F.least("cap", F.col("level") * F.col("weight"))).otherwise(F.col("cap"))
    return rows.select("source", "source_size", target.alias("target"))


def _place(df: DataFrame, key: str, text: str, weight: Column | None, seed: int) -> Column:
    """struct(e, doc_id, size) of a row: rows of a source stand in this order."""
    w = (quality_weight(quoted(text)) if weight is None else weight).cast("double")
    e = exponential_key(quoted(key), F.greatest(F.coalesce(w, F.lit(0.0)), F.lit(0.001)), seed)
    return F.struct(e.alias("e"), quoted(key).alias("doc_id"), word_count(quoted(text)).alias("size"))


def mix(
    df: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: Column | None = None,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    ranges: int = RANGES,
) -> DataFrame:
    """One row per input row: doc_id, size, source, source_size, target, epochs, taken, e, whole.

    Every document is taken once for each whole time that the target holds its source, then
    documents in the order of their exponential keys until the prefix sum of their sizes
    reaches the rest; the document on the edge is taken if most of it is inside. The sum of a
    source is off its target by at most half of one document. A null text has size 0; a null
    source is a source; null or equal keys draw equal numbers, ties go by size; weights that
    are null or not above 0 count as 0.001. No rows in, no rows out.

    A source may hold any share of the rows: its rows are cut into ranges of the exponential
    key, the sums of the ranges are prefix-summed (some thousand rows per source), and only
    inside a range are rows sorted. Rows that agree in all that counts (repeated rows, or null
    keys with texts of one size and weight) are counted before they are shuffled and are one
    row until the end, so a key may hold any share of the rows too.
    """
    drawn = df.select(_place(df, key, text, weight, seed).alias("p"), quoted(source).alias("source"))
    drawn = drawn.select("source", "p.*", F.floor(F.log2("p.e") * F.lit(ranges)).cast("int").alias("part"))
    slim = materialize(drawn.groupBy("source", "part", "e", "doc_id", "size").agg(F.count("*").alias("n")))
    parts = slim.groupBy("source", "part").agg(F.sum(F.col("size") * F.col("n")).alias("part_size"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("part_start", F.coalesce(F.sum("part_size").over(before), F.lit(0)))
    targets = source_targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights=weights, share=share, most=most)
    parts = parts.alias("p").join(targets.alias("t"), F.expr("p.source <=> t.source")).select("p.source", "part", "part_start", "source_size", "target")
    inside = Window.partitionBy("source", "part").orderBy("e", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = slim.withColumn("start", F.coalesce(F.sum(F.col("size") * F.col("n")).over(inside), F.lit(0)))
    rows = rows.alias("r").join(parts.alias("p"), F.expr("r.source <=> p.source AND r.part = p.part")).select(
        "doc_id", "size", "r.source", "source_size", "target", "e", "n", (F.col("part_start") + F.col("start")).alias("start")
    )
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("whole", whole)
    # of n equal rows the i-th (from 0) is taken once more if start + i * size + size / 2 is inside the rest
    rest = F.col("target") - F.col("whole") * F.col("source_size")
    room = rest - F.col("start") - F.col("size") / 2
    more = F.when(room < 0, 0).when(F.col("size") > 0, F.least(F.col("n"), F.floor(room / F.greatest(F.col("size"), F.lit(1))) + 1)).otherwise(F.col("n")).cast("long")
    rows = rows.withColumn("more", more)
    runs = F.array(F.struct((F.col("whole") + 1).alias("epochs"), F.col("more").alias("times")), F.struct(F.col("whole").alias("epochs"), (F.col("n") - F.col("more")).alias("times")))
    rows = repeated(rows.select("*", F.explode(runs).alias("run")), F.col("run.times")).withColumn("epochs", F.col("run.epochs"))
    return rows.select("doc_id", "size", "source", "source_size", "target", "epochs", (F.col("epochs") * F.col("size")).alias("taken"), "e", "whole")


#: Rows of the table of sources up to which it is broadcast.
MOST_SOURCES = 100_000


def mixed_rows(
    df: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weight: Column | None = None,
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    ranges: int = RANGES,
) -> DataFrame:
    """The mix itself: df's rows, each as often as mix() takes it; those taken no time are left out.

    In the order of the exponential key, what a source gives besides whole epochs is a prefix,
    so one cut per source tells it: the texts meet a table of sources and are not shuffled
    unless there are more than MOST_SOURCES of these. Rows that repeat the one on the edge are
    taken with it. The columns are df's own, whatever their names; nulls, ties and empty
    tables are as mix() has them.
    """
    placed = mix(df, key=key, text=text, source=source, weight=weight, weights=weights, share=share, most=most, seed=seed, ranges=ranges)
    place = F.struct(F.col("e"), F.col("doc_id"), F.col("size"))
    cuts = placed.groupBy(F.col("source").alias("of")).agg(F.max("whole").alias("whole"), F.max(F.when(F.col("epochs") > F.col("whole"), place)).alias("cut"))
    cuts = materialize(cuts)
    few = cuts.limit(MOST_SOURCES + 1).count() <= MOST_SOURCES
    rows = df.select(packed(df.columns).alias("row"), quoted(source).alias("source"), _place(df, key, text, weight, seed).alias("place"))
    met = rows.join(F.broadcast(cuts) if few else cuts, F.col("source").eqNullSafe(F.col("of")))
    # where whole epochs fill the target, a text without words fits in once more, though it adds nothing
    copies = F.least(F.col("whole") + F.coalesce((F.col("place") <= F.col("cut")).cast("long"), F.lit(0)), F.ceil(F.lit(most)))
    return met.select("row", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*unpacked(df.columns))
