"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.common import materialize


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b")))


def _stars(edges: DataFrame) -> bool:
    """Whether the edges (a, b), a > b, are stars already: each a has one b, and no b is an a."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("low"), F.lit(0).alias("top")).union(edges.select("b", F.lit(0), F.lit(1)))
    met = ends.groupBy("node").agg(F.sum("low").alias("low"), F.max("top").alias("top"))
    return met.agg(F.coalesce(F.max(F.col("low") + F.col("top")), F.lit(0))).first()[0] <= 1


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the links (a, b): component is the smallest node reachable.

    Any orderable key type. Each pair of rounds keeps the edges no more than the nodes and the
    links, and the table is checkpointed between rounds; the loop ends when the edges are stars,
    so links that are stars take no round. Each round costs the driver some of its memory (plans,
    stages, tasks). Links of a node to itself and repeated links do no harm; no links, no rows.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while not _stars(edges):
        edges = materialize(_small_star(_large_star(edges).distinct()).distinct())
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.union(edges.select("b", "b").distinct())
