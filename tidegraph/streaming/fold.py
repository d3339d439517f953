"""The interval fold over a stream of command files, one tick per micro-batch or numbered directory.

Each batch writes only its compacted commands. Every few ticks those are folded
onto the open edges they touch, which gives the next version of the store: what
it closed, what it opened and the vertices it changed. Now and then, when these
changes have grown to a share of the whole, a version is written in full
instead. The history at any time is the closed intervals plus a fold of the
last version's open edges and the batches since.

    closed/version=<t>/    intervals closed since the version before; written once
    opened/version=<t>/    edges opened since the version before and still open
    open/version=<t>/      all open edges, of a full version
    vertices/version=<t>/  vertices changed since the version before, or all of a full one
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.compact import canonical_pos, compact_batches
from tidegraph.operators.intervals import Mode, as_commands, edge_intervals, graph_status, vertex_fold
from tidegraph.operators.lookup import lookup
from tidegraph.runtime import folder_numbers
from tidegraph.schema import EDGES, OPEN, VERTICES
from tidegraph.streaming.store import TickedStream

LOG_COLUMNS = ["tick", "pos", "op", "src", "dst"]
INTERVALS = ", ".join(f"{f.name} long" for f in EDGES)
# A version is full once what changed since the last full one is that share of it, or after so many versions.
FULL_SHARE, FULL_AFTER = 0.5, 32


class StreamingFold(TickedStream):
    only_for_later = ("open", "opened", "vertices")

    def __init__(self, spark: SparkSession, store: str, mode: Mode = "last_wins", **options):
        super().__init__(spark, store, **options)
        self.mode = mode
        self._there: set[str] = set()

    def edges(self) -> DataFrame:
        """The whole history, ``(src, dst, start_tick, end_tick)``."""
        last = self._last_mark(None)
        recent = edge_intervals(self._log(last.version, last.tick).unionByName(as_commands(self._open(last))), self.mode)
        closed = self._stored("closed").where(F.col("version") <= last.version)
        return closed.select(recent.columns).unionByName(recent)

    def vertices(self) -> DataFrame:
        last = self._last_mark(None)
        return self._vertices(last, last.tick)

    def status(self) -> DataFrame:
        return graph_status(self.edges(), self.vertices())

    def compacted(self, commands: DataFrame) -> DataFrame:
        if self.mode == "last_wins":
            return compact_batches(commands).select(LOG_COLUMNS)
        return commands.select("tick", canonical_pos(), "op", "src", "dst").where("pos IS NOT NULL").distinct()

    def write_version(self, tick: int, last: Row, restored: int | None) -> int:
        log = self._log(last.version, tick)
        full = tick if self._due(last) else last.full
        held = self._open(last)
        # Open edges that no command of the log names stay as they are.
        known = held if full == tick else self._touched(held, log)
        edges = edge_intervals(log.unionByName(as_commands(known)), self.mode).persist()
        try:
            still = F.col("end_tick") == OPEN
            self.overwrite(edges.where(~still), f"closed/version={tick}")
            if full == tick:
                self.overwrite(edges.where(still), f"open/version={tick}")
                self.overwrite(self._vertices(last, tick), f"vertices/version={tick}")
            else:
                self.overwrite(edges.where(still & (F.col("start_tick") > last.version)), f"opened/version={tick}")
                self.overwrite(vertex_fold(log, "remove_then_add"), f"vertices/version={tick}")
        finally:
            edges.unpersist()
        return full

    def _due(self, last: Row) -> bool:
        """Whether the next version is to be a full one. Only the numbers of versions are read."""
        if not last.full:
            return True
        rows = self._stored("open").select("version", F.lit("open").alias("name"))
        for name in ("opened", "closed"):
            rows = rows.unionByName(self._stored(name).select("version", F.lit(name).alias("name")))
        rows = rows.unionByName(self._stored_vertices().select("version", F.lit("vertices").alias("name")))
        whole = (F.col("version") == last.full) & F.col("name").isin("open", "vertices")
        since = (F.col("version") > last.full) & (F.col("version") <= last.version)
        seen = rows.where(whole | since).agg(
            F.count_if(whole).alias("held"), F.count_if(since).alias("changed"), F.count_distinct(F.when(since, F.col("version"))).alias("versions")
        ).first()
        return seen["versions"] >= FULL_AFTER or seen["changed"] >= FULL_SHARE * seen["held"]

    @staticmethod
    def _touched(edges: DataFrame, log: DataFrame) -> DataFrame:
        """Edges of which the log names the pair, or removes an end."""
        pairs = log.where("dst IS NOT NULL").select("src", "dst").distinct()
        gone = log.where("op = 'rmvNode'").select("src").distinct()
        for keys, table in ((["src", "dst"], pairs), (["src"], gone), (["dst"], gone.withColumnRenamed("src", "dst"))):
            name = "named_by_" + "_".join(keys)
            edges = lookup(edges, table.withColumn(name, F.lit(True)), keys)
        named = F.coalesce("named_by_src_dst", "named_by_src", "named_by_dst")
        return edges.where(named).select([f.name for f in EDGES])

    def _log(self, after: int, upto: int) -> DataFrame:
        """The batches after tick ``after``, up to one that is committed or being folded."""
        log = self.spark.read.schema("pos long, op string, src long, dst long, tick long").parquet(f"{self.store}/log")
        return log.where((F.col("tick") > after) & (F.col("tick") <= upto)).select(LOG_COLUMNS)

    def _stored(self, name: str) -> DataFrame:
        return self._table(name, INTERVALS)

    def _stored_vertices(self) -> DataFrame:
        return self._table("vertices", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in VERTICES))

    def _table(self, name: str, schema: str) -> DataFrame:
        path = f"{self.store}/{name}"
        # Leaves a table that exists alone; a new one becomes readable.
        if name not in self._there and not folder_numbers(self.spark, path, "version"):
            self.spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{path}/version=-1")
        self._there.add(name)
        return self.spark.read.schema(f"{schema}, version long").parquet(path)

    def _open(self, last: Row) -> DataFrame:
        """The edges open at the version that ``last`` names: those of the full one, with what changed since."""
        columns = [f.name for f in EDGES]
        since = (F.col("version") > last.full) & (F.col("version") <= last.version)
        rows = self._stored("open").where(F.col("version") == last.full).unionByName(self._stored("opened").where(since))
        ended = self._stored("closed").where(since & (F.col("start_tick") <= F.col("end_tick"))).select("src", "dst", "start_tick")
        return lookup(rows.select(columns), ended.distinct(), ["src", "dst", "start_tick"], "left_anti")

    def _vertices(self, last: Row, upto: int) -> DataFrame:
        # The log is compacted already, so it is folded as it stands.
        recent = vertex_fold(self._log(last.version, upto), "remove_then_add")
        held = (F.col("version") >= last.full) & (F.col("version") <= last.version) & (F.col("version") > 0)
        older = self._stored_vertices().where(held).select(recent.columns)
        return (
            older.unionByName(recent)
            .groupBy("id")
            .agg(F.max("attr").alias("attr"), F.min("first_tick").alias("first_tick"))
        )
