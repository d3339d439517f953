"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.llm.common import stored
from tidegraph.operators.lookup import lookup


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges(a, b)``; the root is a component's smallest node.

    Each round hangs the larger neighbours of a node, then the smaller ones,
    on its smallest neighbour, so paths shorten by about half and edges never
    grow in number. A hub's rows are reduced to one minimum inside tasks and
    joined back by ``lookup``, which lets Spark split them. A round's edges are
    written to the shared folder; the driver sees a count and a checksum. No
    edges: no rows.
    """
    high, low = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    current = stored(edges.where("a <> b").select(high, low).distinct(), "stars")
    before = None
    while (state := _state(current)) != before:
        before = state
        current = stored(_small_star(_large_star(current)), "stars")
    found = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    roots = current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return found.union(roots)


def _state(edges: DataFrame) -> tuple:
    # Every node has one edge, to its root, when the stars stop changing.
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return lookup(both.where("b > a"), least, ["a"], "inner").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """``edges`` have their larger node in ``a``."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = lookup(edges, least, ["a"], "inner").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()
