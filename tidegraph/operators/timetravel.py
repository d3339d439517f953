"""Checkpoints and time travel over the interval table."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions import checkpoint_tick, seen_at
from tidegraph.schema import CHECKPOINT_EVERY


def window_edges(edges: DataFrame, t1: int, t2: int) -> DataFrame:
    """Edges that started in ``[t1, t2)``."""
    return edges.where((F.col("start_tick") >= t1) & (F.col("start_tick") < t2))


def graph_as_of(edges: DataFrame, tick: int) -> DataFrame:
    """Edges open at the end of ``tick``."""
    return edges.where((F.col("start_tick") <= tick) & (F.col("end_tick") > tick))


def checkpoint_at(edges: DataFrame, tick: int) -> DataFrame:
    """The history as it was known at ``tick``."""
    return edges.where(F.col("start_tick") <= tick).withColumn("end_tick", seen_at(F.lit(tick)))


def checkpoints(edges: DataFrame, last_tick: int, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """All checkpoints up to ``last_tick``, one copy of the history so far in each."""
    first = checkpoint_tick(F.col("start_tick"), every)
    ticks = F.sequence(first, F.lit(last_tick).cast("long"), F.lit(every).cast("long"))
    # sequence() rejects reversed bounds, so edges after the last checkpoint skip it.
    return edges.withColumn("tick", F.explode(F.when(first <= last_tick, ticks))).select(
        "tick", "src", "dst", "start_tick", seen_at(F.col("tick")).alias("end_tick")
    )


def covering_checkpoint(tick: int, every: int = CHECKPOINT_EVERY) -> int:
    """The checkpoint a window ending at ``tick`` is read from."""
    return -(-tick // every) * every


def nearest_snapshot(snapshots: DataFrame, given: str) -> DataFrame:
    """The row of ``(snapshot_ms, tick)`` nearest to ``yyyy-MM-dd HH:mm:ss``; the earlier wins a tie.

    One aggregate over the list of snapshots; no row if the list is empty.
    """
    moment = datetime.strptime(given, "%Y-%m-%d %H:%M:%S").replace(tzinfo=timezone.utc)
    distance = F.abs(F.col("snapshot_ms") - F.lit(int(moment.timestamp() * 1000)))
    return snapshots.agg(
        F.min_by(F.struct("snapshot_ms", "tick"), F.struct(distance, F.col("snapshot_ms"))).alias("best")
    ).where("best IS NOT NULL").select("best.*")
