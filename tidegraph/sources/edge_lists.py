"""Labelled edge lists: ``src label dst`` lines, whole or arriving by tick."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Fixed value: the layout of an edge line; further words are ignored.
EDGE_FORM = r"^[+-]?[0-9]+ [^ ]* [+-]?[0-9]+(?: |$)"


def parse_edge_list(lines: DataFrame) -> DataFrame:
    """Any columns beside ``value`` are carried along; unreadable lines are left out."""
    carried = [c for c in lines.columns if c != "value"]
    split = lines.where(F.col("value").rlike(EDGE_FORM)).select(*carried, F.split("value", " ").alias("words"))
    return split.select(
        *carried,
        F.col("words")[0].try_cast("long").alias("src"),
        F.col("words")[2].try_cast("long").alias("dst"),
        F.col("words")[1].alias("label"),
    ).where("src IS NOT NULL AND dst IS NOT NULL")


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    return parse_edge_list(spark.read.text(path))


def append_status(arrivals: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """Edges and vertices in the graph after each tick, when batches only append.

    ``arrivals`` is ``(tick, src, dst, label)``; ``base`` is the labelled graph
    before the first tick. Both counts are first reduced to one row per tick, so
    the running sums see as many rows as there are ticks.
    """
    edges = arrivals.select("tick", "src", "dst")
    if base is not None:
        edges = edges.unionByName(base.select(F.lit(0).cast("long").alias("tick"), "src", "dst"))
    per_tick = edges.groupBy("tick").agg(F.count(F.lit(1)).alias("new_edges"))
    first_seen = (
        edges.select("tick", F.explode(F.array("src", "dst")).alias("id"))
        .groupBy("id")
        .agg(F.min("tick").alias("tick"))
        .groupBy("tick")
        .agg(F.count(F.lit(1)).alias("new_vertices"))
    )
    status = running_status(per_tick.join(first_seen, "tick", "left"))
    return status if base is None else status.where("tick > 0")


def running_status(per_tick: DataFrame) -> DataFrame:
    """``(tick, num_edges, num_vertices)`` of ``(tick, new_edges, new_vertices)``, one row per tick."""
    running = W.orderBy("tick").rowsBetween(W.unboundedPreceding, W.currentRow)
    return per_tick.select(
        "tick",
        F.sum("new_edges").over(running).alias("num_edges"),
        F.sum(F.coalesce("new_vertices", F.lit(0))).over(running).cast("long").alias("num_vertices"),
    )
