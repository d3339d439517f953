"""Folding a log strictly in order into a labelled graph without history.

Positions are unique over the whole log. What a command leaves behind depends
only on the last removal that matches it, so no step runs command by command.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tidegraph.functions import last_pos
from tidegraph.operators.intervals import later
from tidegraph.operators.lookup import lookup
from tidegraph.operators.timetravel import nearest_snapshot


def _node_removals(commands: DataFrame) -> DataFrame:
    return (
        commands.where(F.col("op") == "rmvNode")
        .groupBy(F.col("src").alias("id"))
        .agg(F.max("pos").alias("gone"))
    )


def _with_endpoint_removals(pairs: DataFrame, commands: DataFrame) -> DataFrame:
    gone = _node_removals(commands)
    for end in ("src", "dst"):
        pairs = lookup(pairs, gone.select(F.col("id").alias(end), F.col("gone").alias(f"{end}_gone")), [end])
    return pairs


def fold_bag(commands: DataFrame) -> DataFrame:
    """Every surviving addition, duplicates kept; a removal matches pair and label.

    The point after which an addition survives is worked out once per distinct
    edge. Only then do the additions meet it, one lookup row per edge, so a
    popular edge can be split over tasks.
    """
    keys = ["src", "dst", "label"]
    edges = commands.where(F.col("op").isin("addEdge", "rmvEdge"))
    adding = F.col("op") == "addEdge"
    each = edges.groupBy(*keys).agg(last_pos(adding).alias("added"), last_pos(~adding).alias("removed"))
    cut = (
        _with_endpoint_removals(each, commands)
        .withColumn("cut", F.greatest("removed", "src_gone", "dst_gone"))
        .where(F.col("added") > F.col("cut"))
        .select(*keys, "cut")
    )
    adds = edges.where(adding).select("pos", *keys)
    return lookup(adds, cut, keys, "inner").where(F.col("pos") > F.col("cut")).select("pos", *keys)


def fold_set(commands: DataFrame) -> DataFrame:
    """Distinct surviving edges; a removal matches the pair whatever the label."""
    added = (
        commands.where(F.col("op") == "addEdge").groupBy("src", "dst", "label").agg(F.max("pos").alias("added"))
    )
    removed = (
        commands.where(F.col("op") == "rmvEdge").groupBy("src", "dst").agg(F.max("pos").alias("removed"))
    )
    cut = F.coalesce(F.greatest("removed", "src_gone", "dst_gone"), F.lit(-1))
    return (
        _with_endpoint_removals(lookup(added, removed, ["src", "dst"]), commands)
        .where(F.col("added") > cut)
        .select("src", "dst", "label")
    )


def present_vertices(commands: DataFrame) -> DataFrame:
    """Vertices last named by an addition after their last removal."""
    ids = F.when(F.col("op") == "addEdge", F.array("src", "dst")).otherwise(F.array("src"))
    return (
        commands.where(F.col("op").isin("addEdge", "addNode", "rmvNode"))
        .select("op", "pos", F.explode(ids).alias("id"))
        .groupBy("id")
        .agg(
            last_pos(F.col("op") != "rmvNode").alias("named"),
            last_pos(F.col("op") == "rmvNode").alias("gone"),
        )
        .where("named > gone")
        .select("id")
    )


def named_vertices(commands: DataFrame, default: str | None = "") -> DataFrame:
    """Present vertices with the last name given since their last removal, else ``default``."""
    ids = F.when(F.col("op") == "addEdge", F.array("src", "dst")).otherwise(F.array("src"))
    name_pos = F.when((F.col("op") == "addNode") & F.col("label").isNotNull(), F.col("pos"))
    return (
        commands.where(F.col("op").isin("addEdge", "addNode", "rmvNode"))
        .select("op", "pos", "label", F.explode(ids).alias("id"))
        .groupBy("id")
        .agg(
            last_pos(F.col("op") != "rmvNode").alias("named"),
            last_pos(F.col("op") == "rmvNode").alias("gone"),
            F.max(name_pos).alias("name_pos"),
            F.max_by("label", name_pos).alias("name"),
        )
        .where("named > gone")
        .select("id", F.coalesce(F.when(F.col("name_pos") > F.col("gone"), F.col("name")), F.lit(default)).alias("name"))
    )


def labelled_lifetimes(commands: DataFrame) -> DataFrame:
    """How long each addition of the bag fold lasts: ``(src, dst, label, start_tick, end_tick)``.

    ``end_tick`` is NULL for an addition that is never removed. One addition
    removed in its own tick has ``end_tick = start_tick`` and is in no snapshot.
    """
    def fates(keys: list[str], removals: DataFrame, asked: DataFrame, prefix: str) -> DataFrame:
        return (
            asked.select(*keys, "tick", F.lit(None).cast("long").alias("last"))
            .unionByName(removals.select(*keys, "tick", F.col("pos").alias("last")))
            .groupBy(*keys, "tick")
            .agg(F.max("last").alias(f"{prefix}_last"))
            .withColumn(
                f"{prefix}_next",
                F.min(F.when(F.col(f"{prefix}_last").isNotNull(), F.col("tick"))).over(later(*keys)),
            )
        )

    adds = commands.where(F.col("op") == "addEdge").select("tick", "pos", "src", "dst", "label")
    removed = commands.where(F.col("op") == "rmvEdge")
    gone = commands.where(F.col("op") == "rmvNode").select("tick", "pos", F.col("src").alias("id"))
    edge = ["src", "dst", "label"]
    distinct_adds = adds.select("tick", *edge).distinct()
    ends = fates(edge, removed, adds, "edge")
    nodes = fates(["id"], gone, distinct_adds.select("tick", F.explode(F.array("src", "dst")).alias("id")), "node")
    for end in ("src", "dst"):
        ends = lookup(
            ends,
            nodes.select(
                F.col("id").alias(end), "tick", F.col("node_last").alias(f"{end}_last"),
                F.col("node_next").alias(f"{end}_next"),
            ),
            [end, "tick"],
        )
    ends = ends.select(
        *edge, "tick",
        F.greatest("edge_last", "src_last", "dst_last").alias("last"),
        F.least("edge_next", "src_next", "dst_next").alias("next"),
    )
    return lookup(adds, ends, [*edge, "tick"]).select(
        *edge,
        F.col("tick").alias("start_tick"),
        F.when(F.col("last") > F.col("pos"), F.col("tick")).otherwise(F.col("next")).alias("end_tick"),
    )


def last_restore(commands: DataFrame) -> Row | None:
    """Position and time of the last ``loadOld``. One row, so it is read back."""
    return (
        commands.where(F.col("op") == "loadOld")
        .agg(F.max_by(F.struct("pos", "label"), "pos").alias("load"))
        .first()["load"]
    )


def restore_then_fold(
    commands: DataFrame, read_base: Callable[[int], DataFrame], snapshots: DataFrame
) -> DataFrame:
    """The bag fold of a log that may restore a snapshot on its way.

    The last ``loadOld`` replaces the whole graph by the nearest snapshot, so only
    that snapshot and the commands after it matter. ``read_base(tick)`` gives the
    labelled edges of a snapshot.
    """
    load = last_restore(commands)
    if load is None:
        return fold_bag(commands).select("src", "dst", "label")
    found = nearest_snapshot(snapshots, load["label"]).first()
    rest = commands.where(F.col("pos") > load["pos"]).select("pos", "op", "src", "dst", "label")
    if found is None:
        return fold_bag(rest).select("src", "dst", "label")
    # The restored edges stand before every later command.
    base = read_base(found["tick"]).select(
        F.lit(load["pos"]).cast("long").alias("pos"), F.lit("addEdge").alias("op"), "src", "dst", "label"
    )
    return fold_bag(base.unionByName(rest)).select("src", "dst", "label")
