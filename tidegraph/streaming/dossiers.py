"""Dossiers of the vertices that a micro-batch touched, written for these alone.

    log/batch=<b>/    the commands of the batch
    lines/batch=<b>/  dossier lines of the vertices it touched
    touched/batch=<b>/  their ids; one may have no line any more

A batch without commands writes nothing. Folders are named by batch and written
over, so a batch that is replayed leaves the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegraph.operators.lookup import lookup
from tidegraph.sources.commands import numbered_lines, parse_commands

LOG = "pos long, op string, src long, label string, dst long"
LINES = "id long, section string, seq long, line string"


class DossierStream:
    """``dossier`` makes ``(id, section, seq, line)`` of a command log; it may read of a vertex its own
    commands, those of its edges, and removals of the vertices at their other ends."""

    def __init__(self, spark: SparkSession, store: str, dossier: Callable[[DataFrame], DataFrame], parse=parse_commands):
        self.spark, self.store, self.dossier, self.parse = spark, store.rstrip("/"), dossier, parse
        # Leaves a store that exists alone; a new one becomes readable.
        for name, schema in (("log", LOG), ("lines", LINES), ("touched", "id long")):
            spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{self.store}/{name}/batch=-1")

    def start(self, lines: DataFrame, **trigger) -> StreamingQuery:
        return (
            lines.writeStream.foreachBatch(self.apply)
            .option("checkpointLocation", f"{self.store}/progress").trigger(**trigger).start()
        )

    def _read(self, name: str, schema: str, upto: int | None = None) -> DataFrame:
        rows = self.spark.read.schema(f"{schema}, batch long").parquet(f"{self.store}/{name}")
        return rows if upto is None else rows.where(F.col("batch") <= upto)

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Write the dossiers the commands of one micro-batch change."""
        lines = numbered_lines(batch.withColumn("batch", F.lit(0))).withColumn("tick", F.lit(0).cast("long"))
        commands = self.parse(lines).select("pos", "op", "src", "label", "dst").persist()
        try:
            if commands.isEmpty():
                return
            # Ranks of splits start anew in each batch, so positions go on from the last one.
            before = self._read("log", LOG).where(F.col("batch") < batch_id).agg(F.max("pos")).first()[0]
            after = F.lit(0 if before is None else before + 1).cast("long")
            commands.withColumn("pos", F.col("pos") + after).write.mode("overwrite").parquet(f"{self.store}/log/batch={batch_id}")
        finally:
            commands.unpersist()
        log = self._read("log", LOG, batch_id)
        touched = self._touched(log, batch_id)
        touched.write.mode("overwrite").parquet(f"{self.store}/touched/batch={batch_id}")
        touched = self._read("touched", "id long").where(F.col("batch") == batch_id).select("id")
        found = lookup(self.dossier(self._about(log, touched)), touched, ["id"], "left_semi")
        found.write.mode("overwrite").parquet(f"{self.store}/lines/batch={batch_id}")

    @staticmethod
    def _touched(log: DataFrame, batch_id: int) -> DataFrame:
        """Vertices that commands of the batch name, and neighbours of those it removes."""
        own = log.where(F.col("batch") == batch_id)
        named = own.select(F.explode(F.array("src", "dst")).alias("id")).where("id IS NOT NULL").distinct()
        gone = own.where("op = 'rmvNode'").select("src").distinct()
        added = log.where("op = 'addEdge'").select("src", "dst")
        ahead = lookup(added, gone, ["src"], "left_semi").select(F.col("dst").alias("id"))
        behind = lookup(added, gone.withColumnRenamed("src", "dst"), ["dst"], "left_semi").select(F.col("src").alias("id"))
        return named.union(ahead).union(behind).distinct()

    @staticmethod
    def _about(log: DataFrame, touched: DataFrame) -> DataFrame:
        """The commands that the dossiers of ``touched`` follow from."""
        log = log.drop("batch")
        src, dst = touched.select(F.col("id").alias("src")), touched.select(F.col("id").alias("dst"))
        forth = lookup(log, src, ["src"], "left_semi")
        back = lookup(lookup(log, dst, ["dst"], "left_semi"), src, ["src"], "left_anti")
        own = forth.unionByName(back, allowMissingColumns=True)
        others = own.select(F.explode(F.array("src", "dst")).alias("src")).distinct()
        others = lookup(others.where("src IS NOT NULL"), src, ["src"], "left_anti")
        rest = lookup(log.where("op IN ('rmvNode', 'addNode')"), others, ["src"], "left_semi")
        return own.unionByName(rest, allowMissingColumns=True).select("pos", "op", "src", "label", "dst")

    def dossiers(self) -> DataFrame:
        """``(id, section, seq, line)``: of each vertex what the last batch that touched it wrote."""
        last = self._read("touched", "id long").groupBy("id").agg(F.max("batch").alias("batch"))
        return lookup(self._read("lines", LINES), last, ["id", "batch"], "left_semi").drop("batch")
