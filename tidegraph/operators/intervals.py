"""Folding a command log into validity intervals, all ticks in one plan."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.operators.compact import compact_batches, last_node_removal, last_per_pair
from tidegraph.operators.lookup import lookup
from tidegraph.schema import OPEN

Mode = Literal["last_wins", "remove_then_add"]


def later(*keys: str):
    """Rows of the same key at strictly later ticks.

    Descending order makes this a growing frame, which Spark scans once; the
    same frame written as "following" would be rescanned for every row.
    """
    return W.partitionBy(*keys).orderBy(F.desc("tick")).rangeBetween(W.unboundedPreceding, -1)


def _node_fates(opens: DataFrame, commands: DataFrame) -> DataFrame:
    """Per (node, tick) an open asks about: its last removal then, and its next one.

    Both inputs are reduced to one row per node and tick before the window, so
    even a hub brings at most one row per tick.
    """
    asked = opens.select(F.explode(F.array("src", "dst")).alias("id"), "tick")
    return (
        asked.unionByName(last_node_removal(commands), allowMissingColumns=True)
        .groupBy("id", "tick")
        .agg(F.max("gone").alias("gone"))
        .withColumn("next_gone", F.min(F.when(F.col("gone").isNotNull(), F.col("tick"))).over(later("id")))
        .where("gone IS NOT NULL OR next_gone IS NOT NULL")
    )


def edge_intervals(commands: DataFrame, mode: Mode = "last_wins", upto: int | None = None) -> DataFrame:
    """Every interval each edge was open: ``(src, dst, start_tick, end_tick)``.

    With ``upto`` the history as it was known at that tick, which is a fold of
    the commands up to it; the others are filtered out at the scan.

    An interval ends at the first tick after its start that removes the pair or
    an endpoint. Opens of a pair that end at the same tick are one interval.
    ``last_wins`` cancels within a tick by position, ``remove_then_add`` applies
    all removals of a tick before its additions.

    Also folds a log made of compacted batches, and open edges of an earlier
    fold given as ``addEdge`` commands at their start ticks.

    Opens meet the removals of their endpoints first and the closings of their
    pair last: the final aggregation then finds the rows partitioned by pair.
    """
    ordered = mode == "last_wins"
    if upto is not None:
        commands = commands.where(F.col("tick") <= upto)
    pairs = last_per_pair(commands)
    closes = pairs.where((F.col("removed") > F.col("added")) if ordered else (F.col("removed") >= 0))
    opens = pairs.where((F.col("added") > F.col("removed")) if ordered else (F.col("added") >= 0))
    opens = opens.select("src", "dst", "tick", "added")
    fates = _node_fates(opens, commands)
    for end in ("src", "dst"):
        opens = lookup(
            opens,
            fates.select(
                F.col("id").alias(end), "tick", F.col("gone").alias(f"{end}_gone"),
                F.col("next_gone").alias(f"{end}_next"),
            ),
            [end, "tick"],
        )
    if ordered:
        opens = opens.where(F.col("added") > F.coalesce(F.greatest("src_gone", "dst_gone"), F.lit(-1)))
    opened = opens.select(
        "src", "dst", "tick", F.lit(True).alias("opened"), F.least("src_next", "dst_next").alias("node_close")
    )
    closed = closes.select(
        "src", "dst", "tick", F.lit(False).alias("opened"), F.lit(None).cast("long").alias("node_close")
    )
    next_close = F.min(F.when(~F.col("opened"), F.col("tick"))).over(later("src", "dst"))
    return (
        opened.unionByName(closed)
        .withColumn("next_close", next_close)
        .where("opened")
        .withColumn("end_tick", F.coalesce(F.least("next_close", "node_close"), F.lit(OPEN)))
        .groupBy("src", "dst", "end_tick")
        .agg(F.min("tick").alias("start_tick"))
        .select("src", "dst", "start_tick", "end_tick")
    )


def as_commands(open_edges: DataFrame) -> DataFrame:
    """Open intervals as the additions that opened them, to fold further batches onto."""
    return open_edges.select(
        F.col("start_tick").alias("tick"), F.lit(2).cast("long").alias("pos"), F.lit("addEdge").alias("op"),
        "src", "dst",
    )


def vertex_fold(commands: DataFrame, mode: Mode = "last_wins") -> DataFrame:
    """``(id, attr, first_tick)``: every vertex ever added or implied by an edge.

    ``attr`` is 1 if a node addition survived some batch, 0 if only edges imply
    the vertex. Removed vertices stay, as their closed edges do.
    """
    log = compact_batches(commands) if mode == "last_wins" else commands
    explicit = F.col("op") == "addNode"
    ids = F.when(explicit, F.array("src")).otherwise(F.array("src", "dst"))
    return (
        log.where(F.col("op").isin("addNode", "addEdge"))
        .select("tick", explicit.cast("int").alias("attr"), F.explode(ids).alias("id"))
        .groupBy("id")
        .agg(F.max("attr").alias("attr"), F.min("tick").alias("first_tick"))
    )


def graph_status(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Size of the graph after each tick that changed it; closed intervals count as edges."""
    zero, one = F.lit(0), F.lit(1)

    def change(tick: Column, e: Column, c: Column, v: Column) -> Column:
        return F.struct(tick.alias("tick"), e.alias("e"), c.alias("c"), v.alias("v"))

    closing = F.when(F.col("end_tick") < OPEN, F.col("end_tick"))
    changes = (
        edges.select(
            F.explode(F.array(change(F.col("start_tick"), one, zero, zero), change(closing, zero, one, zero))).alias("x")
        )
        .unionByName(vertices.select(change(F.col("first_tick"), zero, zero, one).alias("x")))
        .select("x.*")
        .where("tick IS NOT NULL")
        .groupBy("tick")
        .agg(F.sum("e").alias("e"), F.sum("c").alias("c"), F.sum("v").alias("v"))
    )
    # One row per tick by now, so the running sums may share one task.
    running = W.orderBy("tick").rowsBetween(W.unboundedPreceding, W.currentRow)
    return changes.select(
        "tick",
        F.sum("e").over(running).alias("num_edges"),
        F.sum(F.col("e") - F.col("c")).over(running).alias("open_edges"),
        F.sum("c").over(running).alias("closed_edges"),
        F.sum("v").over(running).alias("num_vertices"),
    )
