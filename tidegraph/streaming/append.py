"""Edge lists that only grow, on a stream: how many edges and vertices there are after each tick.

Numbered directories are ticks. Which vertices have been seen is the state of a
streaming aggregation, which Spark keeps by vertex in its state store; a batch
touches its own vertices only and writes one row for each of its ticks.

    counts/batch=<b>/   new edges and new vertices by tick
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegraph.sources.edge_lists import parse_edge_list, running_status

COUNTS = "tick long, new_edges long, new_vertices long"


class EdgeAppends:
    def __init__(self, spark: SparkSession, store: str):
        self.spark, self.store = spark, store.rstrip("/")
        # Leaves a store that exists alone; a new one becomes readable.
        spark.createDataFrame([], COUNTS).write.mode("ignore").parquet(f"{self.store}/counts/batch=-1")

    def start(self, lines: DataFrame, **trigger) -> StreamingQuery:
        """Run on ``command_stream`` over numbered directories; directory ``n`` is tick ``n + 1``."""
        rows = parse_edge_list(lines.where("batch IS NOT NULL").select((F.col("batch") + 1).alias("tick"), "value"))
        # An edge is a row of its tick, an end of an edge a row of its vertex.
        ends = F.array(F.col("src"), F.col("dst"), F.lit(None).cast("long"))
        seen = rows.select("tick", F.explode(ends).alias("id"))
        of_edges = F.when(F.col("id").isNull(), F.col("tick")).alias("edges_of")
        state = seen.groupBy("id", of_edges).agg(F.min("tick").alias("tick"), F.max("tick").alias("last"), F.count(F.lit(1)).alias("n"))
        return (
            state.writeStream.outputMode("update").foreachBatch(self._write)
            .option("checkpointLocation", f"{self.store}/progress").trigger(**trigger).start()
        )

    def _write(self, changed: DataFrame, batch_id: int) -> None:
        changed = changed.persist()
        try:
            done = self._counts().where(F.col("batch") < batch_id).agg(F.max("tick")).first()[0]
            is_edge = F.col("id").isNull()
            # A tick that went on after it was counted would change what has been said of it.
            late = is_edge & (F.col("tick") <= F.lit(done))
            if done is not None and not changed.where(late).isEmpty():
                raise ValueError(f"a directory has new files after tick {done} was counted")
            fresh = changed.where(F.lit(done).isNull() | (F.col("tick") > F.lit(done)))
            counts = fresh.groupBy("tick").agg(
                F.coalesce(F.sum(F.when(is_edge, F.col("n"))), F.lit(0)).alias("new_edges"), F.count("id").alias("new_vertices")
            )
            counts.write.mode("overwrite").parquet(f"{self.store}/counts/batch={batch_id}")
        finally:
            changed.unpersist()

    def _counts(self) -> DataFrame:
        return self.spark.read.schema(f"{COUNTS}, batch long").parquet(f"{self.store}/counts")

    def status(self) -> DataFrame:
        """``(tick, num_edges, num_vertices)`` after each tick."""
        return running_status(self._counts().drop("batch"))
