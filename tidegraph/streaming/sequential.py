"""The in-order fold over a stream, with snapshots a ``loadOld`` command can restore.

A batch leaves the removals it makes in the graph it finds and the additions that
survive it, in that order, so the logs of several batches still fold as one.
Versions serve as snapshots, known by the time their last batch was folded.

    edges/version=<t>/     all edges
    vertices/version=<t>/  all vertices
"""

from __future__ import annotations

from typing import Literal

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.compact import CANONICAL_POS, canonical_pos
from tidegraph.operators.static import fold_bag, fold_set, last_restore, named_vertices
from tidegraph.operators.timetravel import nearest_snapshot
from tidegraph.schema import LABELLED_EDGES
from tidegraph.streaming.store import TickedStream

LOG = "pos long, op string, src long, label string, dst long, tick long"
LOG_COLUMNS = ["tick", "pos", "op", "src", "label", "dst"]


class SequentialFold(TickedStream):
    restores = True

    def __init__(
        self, spark: SparkSession, store: str, keep: Literal["bag", "set"] = "bag", default_name: str = "", **options
    ):
        super().__init__(spark, store, **options)
        self.keep, self.default_name = keep, default_name

    def edges(self) -> DataFrame:
        """``(src, dst, label)``; duplicates count in a bag."""
        tick = self.tick()
        return self._edges(*self._state(tick), tick)

    def vertices(self) -> DataFrame:
        """``(id, name)``"""
        tick = self.tick()
        return self._vertices(*self._state(tick), tick)

    def restored(self, commands: DataFrame, tick: int) -> int | None:
        load = last_restore(commands)
        if load is None:
            return None
        saved = self.ticks().where((F.col("tick") < tick) & (F.col("tick") == F.col("version")))
        found = nearest_snapshot(saved, load["label"]).first()
        # Without a snapshot the graph goes back to the empty one, which version 0 stands for.
        return 0 if found is None else found["tick"]

    def compacted(self, commands: DataFrame) -> DataFrame:
        load = last_restore(commands)
        if load is not None:
            commands = commands.where(F.col("pos") > load["pos"])
        adds = (fold_bag(commands) if self.keep == "bag" else fold_set(commands)).select(
            F.lit("addEdge").alias("op"), "src", "label", "dst"
        )
        named = named_vertices(commands, None).select(
            F.lit("addNode").alias("op"), F.col("id").alias("src"), F.col("name").alias("label"),
            F.lit(None).cast("long").alias("dst"),
        )
        removals = commands.where(F.col("op").isin("rmvEdge", "rmvNode")).select("op", "src", "label", "dst").distinct()
        return removals.unionByName(adds).unionByName(named).select(
            F.lit(None).cast("long").alias("tick"), canonical_pos(), "op", "src", "label", "dst"
        )

    def write_version(self, tick: int, last: Row, restored: int | None) -> int:
        base, after = self._state(tick - 1, last.version) if restored is None else (restored, tick - 1)
        self.overwrite(self._edges(base, after, tick), f"edges/version={tick}")
        self.overwrite(self._vertices(base, after, tick), f"vertices/version={tick}")
        return tick

    def _state(self, tick: int, version: int | None = None) -> tuple[int, int]:
        """The version to start from and the tick after which the log applies."""
        version = self._last_mark(None).version if version is None else version
        restores = self.ticks().where(F.col("base").isNotNull() & (F.col("tick") > version) & (F.col("tick") <= tick))
        last = restores.agg(F.max_by(F.struct("base", "tick"), "tick").alias("last")).first()["last"]
        return (version, version) if last is None else (last["base"], last["tick"] - 1)

    def _log(self, after: int, upto: int) -> DataFrame:
        log = self.spark.read.schema(LOG).parquet(f"{self.store}/log")
        log = log.where((F.col("tick") > after) & (F.col("tick") <= upto))
        # One order over all ticks; whatever a version holds comes before at position 0.
        return log.withColumn("pos", F.col("tick") * len(CANONICAL_POS) + F.col("pos")).select(LOG_COLUMNS)

    def _edges(self, base: int, after: int, upto: int) -> DataFrame:
        log = self._log(after, upto).drop("tick")
        if base:
            held = self.spark.read.schema(LABELLED_EDGES).parquet(f"{self.store}/edges/version={base}")
            log = log.unionByName(held.withColumn("op", F.lit("addEdge")).withColumn("pos", F.lit(0).cast("long")))
        return (fold_bag(log) if self.keep == "bag" else fold_set(log)).select("src", "dst", "label")

    def _vertices(self, base: int, after: int, upto: int) -> DataFrame:
        log = self._log(after, upto).drop("tick")
        if base:
            held = self.spark.read.schema("id long, name string").parquet(f"{self.store}/vertices/version={base}")
            log = log.unionByName(
                held.select(
                    F.lit(0).cast("long").alias("pos"), F.lit("addNode").alias("op"), F.col("id").alias("src"),
                    F.col("name").alias("label"), F.lit(None).cast("long").alias("dst"),
                )
            )
        return named_vertices(log, self.default_name)
