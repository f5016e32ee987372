"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Edges up to which the table of their nodes' smallest neighbours, of two rows an edge at most, is broadcast.
BROADCAST_EDGES = 200_000


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _beside(edges: DataFrame, least: DataFrame, scratch: C.Scratch, few: bool) -> DataFrame:
    """edges joined with (u, m) of their node a.

    The minima of few edges are broadcast. Those of more are kept first: a join with an aggregate
    shares its shuffle, and Spark doesn't split a hot node's partition there; with a kept table it does.
    """
    other = F.broadcast(least) if few else scratch.keep(least).hint("merge")
    return edges.join(other, F.col("a") == F.col("u"))


def _large_star(edges: DataFrame, scratch: C.Scratch, few: bool) -> DataFrame:
    """Each node's larger neighbours move to its smallest neighbour, or to the node itself."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return _beside(both.filter("b > a"), least, scratch, few).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame, scratch: C.Scratch, few: bool) -> DataFrame:
    """Each node and its smaller neighbours move to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "u")
    moved = _beside(edges, least, scratch, few).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("u", "m")).distinct()


def components(edges: DataFrame, scratch: C.Scratch) -> DataFrame:
    """(node, component): for each node that has an edge and isn't the smallest of its component, that smallest node.

    edges has columns a and b; self-links and edges with a null mean nothing. A node of very many edges spreads over tasks:
    its minimum is aggregated before the shuffle, and the join that follows is a broadcast or one that Spark
    splits. Each round is a kept table, and the one before is dropped.
    """
    now = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = scratch.keep(now)
    state = _state(now)
    while state[0]:
        few, round_ = state[0] <= BROADCAST_EDGES, C.Scratch(scratch.spark)
        half = _large_star(now, round_, few)
        half = half if few else round_.keep(half)
        after = scratch.keep(_small_star(half, round_, few))
        scratch.drop(now)
        round_.drop(*[t for t, _ in round_.kept])
        now, before, state = after, state, _state(after)
        if state == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def merged(found: DataFrame, more: DataFrame, scratch: C.Scratch) -> DataFrame:
    """found (node, component) of `components`, with links more (a, b) added: only what these join is worked out again."""
    if more.isEmpty():
        return found
    own = found.select(F.col("node").alias("n"), F.col("component").alias("c"))
    links = more
    for end in ("a", "b"):
        links = links.join(own, F.col(end) == F.col("n"), "left").withColumn(end, F.coalesce("c", end)).drop("n", "c")
    tops = scratch.keep(components(links, scratch))
    if tops.isEmpty():
        return found
    top = C.sized(tops.withColumnsRenamed({"node": "n", "component": "c"}), BROADCAST_EDGES)
    moved = found.join(top, F.col("component") == F.col("n"), "left").select("node", F.coalesce("c", "component").alias("component"))
    return scratch.keep(moved.unionByName(tops))
