"""In-batch compaction of a command log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegraph.functions import last_pos
from tidegraph.operators.lookup import lookup

# Place of each operation in a compacted batch: removals come before additions.
CANONICAL_POS = {"rmvNode": 0, "rmvEdge": 1, "addEdge": 2, "addNode": 3}


def canonical_pos() -> Column:
    """The place of the row's operation, NULL for one that is none of the four."""
    place = F.lit(None).cast("long")
    for op, pos in CANONICAL_POS.items():
        place = F.when(F.col("op") == op, F.lit(pos).cast("long")).otherwise(place)
    return place.alias("pos")


def last_per_pair(commands: DataFrame) -> DataFrame:
    """Last addition and removal of every pair in every tick.

    The maxima are taken before the shuffle, so a pair repeated without end
    sends one row per input partition.
    """
    return (
        commands.where(F.col("op").isin("addEdge", "rmvEdge"))
        .groupBy("tick", "src", "dst")
        .agg(
            last_pos(F.col("op") == "addEdge").alias("added"),
            last_pos(F.col("op") == "rmvEdge").alias("removed"),
        )
    )


def last_node_removal(commands: DataFrame) -> DataFrame:
    return (
        commands.where(F.col("op") == "rmvNode")
        .groupBy("tick", F.col("src").alias("id"))
        .agg(F.max("pos").alias("gone"))
    )


def compact_batches(commands: DataFrame) -> DataFrame:
    """The shortest log with the effect of each batch, later commands winning.

    In a tick an edge is opened iff its last addition is after every removal of
    the pair or an endpoint, closed iff its last removal is after all of those
    and the addition, and a node is removed iff any command removes it. A node
    is added iff a surviving command names it and no opened edge implies it.
    Compacting the result again changes nothing.

    Returns ``(tick, pos, op, src, dst)``; node commands have no ``dst``.
    """
    gone = last_node_removal(commands)
    absent = F.lit(-1).cast("long")
    pairs = last_per_pair(commands)
    for end in ("src", "dst"):
        pairs = lookup(
            pairs, gone.select("tick", F.col("id").alias(end), F.col("gone").alias(f"{end}_gone")), ["tick", end]
        )
    pairs = (
        pairs.na.fill(-1, ["src_gone", "dst_gone"])
        .withColumn("open", F.col("added") > F.greatest("removed", "src_gone", "dst_gone"))
        .withColumn("close", F.col("removed") > F.greatest("added", "src_gone", "dst_gone"))
    )
    edges = pairs.where("open OR close").select(
        "tick", F.when(F.col("open"), "addEdge").otherwise("rmvEdge").alias("op"), "src", "dst"
    )

    named = pairs.where("added >= 0").select(
        "tick", F.explode(F.array("src", "dst")).alias("id"), F.col("added").alias("named"), "open"
    )
    nodes = commands.where(F.col("op").isin("addNode", "rmvNode")).select(
        "tick", F.col("src").alias("id"), "op", "pos"
    )
    fates = (
        named.unionByName(nodes, allowMissingColumns=True)
        .groupBy("tick", "id")
        .agg(
            F.coalesce(F.max("named"), absent).alias("named"),
            F.coalesce(F.bool_or("open"), F.lit(False)).alias("implied"),
            last_pos(F.col("op") == "addNode").alias("added"),
            last_pos(F.col("op") == "rmvNode").alias("gone"),
        )
    )
    kept = (F.col("added") > F.col("gone")) | ((F.col("named") > F.col("gone")) & ~F.col("implied"))
    ops = F.filter(
        F.array(F.when(F.col("gone") >= 0, "rmvNode"), F.when(kept, "addNode")), lambda op: op.isNotNull()
    )
    node_rows = fates.select(
        "tick", F.explode(ops).alias("op"), F.col("id").alias("src"), F.lit(None).cast("long").alias("dst")
    )
    return edges.unionByName(node_rows).select("tick", canonical_pos(), "op", "src", "dst")
