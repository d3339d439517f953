"""The history on disk by the checkpoints between which edges started and ended.

    open=<bool>/started=<c>/ended=<c>/   c is the first checkpoint at or after the tick

Every interval is stored once, so the store grows with the history and not with
the number of checkpoints. Open edges stand apart with ``ended`` empty. A
question about a tick prunes directories by both ends before a file is opened,
and a checkpoint is what its own directories add to the one before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.functions import checkpoint_tick, seen_at
from tidegraph.schema import CHECKPOINT_EVERY, EDGES, OPEN

_LAYOUT = ["open", "started", "ended"]


def write_intervals(edges: DataFrame, path: str, every: int = CHECKPOINT_EVERY, mode: str = "errorifexists") -> None:
    """``edges(src, dst, start_tick, end_tick)`` into a store with a checkpoint every ``every`` ticks.

    With ``mode="append"`` later closed intervals and open edges are added;
    ``replace_open`` takes the place of the open ones.
    """
    is_open = F.col("end_tick") == OPEN
    placed = edges.select("src", "dst", "start_tick", "end_tick").withColumns({
        "open": is_open,
        "started": checkpoint_tick(F.col("start_tick"), every),
        "ended": F.when(~is_open, checkpoint_tick(F.col("end_tick"), every)),
    })
    placed.write.mode(mode).partitionBy(*_LAYOUT).parquet(path)


def _stored(spark: SparkSession, path: str) -> DataFrame:
    columns = ", ".join(f"{f.name} long" for f in EDGES)
    return spark.read.schema(f"{columns}, open boolean, started long, ended long").parquet(path)


def read_intervals(spark: SparkSession, path: str) -> DataFrame:
    """The whole history."""
    return _stored(spark, path).drop(*_LAYOUT)


def _of(tick: int, every: int) -> int:
    return -(-tick // every) * every


def intervals_as_of(spark: SparkSession, path: str, tick: int, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """Edges open at the end of ``tick``, from the directories that can hold one."""
    place = _of(tick, every)
    may = (F.col("started") <= place) & (F.col("open") | (F.col("ended") >= place))
    there = (F.col("start_tick") <= tick) & (F.col("end_tick") > tick)
    return _stored(spark, path).where(may & there).drop(*_LAYOUT)


def intervals_at(spark: SparkSession, path: str, checkpoint: int, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """The history as the checkpoint at tick ``checkpoint`` knows it: whatever started later is not read."""
    rows = _stored(spark, path).where((F.col("started") <= _of(checkpoint, every)) & (F.col("start_tick") <= checkpoint))
    return rows.withColumn("end_tick", seen_at(F.lit(checkpoint))).drop(*_LAYOUT)


def window_of(spark: SparkSession, path: str, t1: int, t2: int, every: int = CHECKPOINT_EVERY) -> DataFrame:
    """Edges that started in ``[t1, t2)``, from the directories of those checkpoints."""
    may = (F.col("started") >= _of(t1, every)) & (F.col("started") <= _of(t2 - 1, every))
    return _stored(spark, path).where(may & (F.col("start_tick") >= t1) & (F.col("start_tick") < t2)).drop(*_LAYOUT)


def checkpoint_deltas(spark: SparkSession, path: str, checkpoint: Column | int | None = None) -> DataFrame:
    """``(tick, change, src, dst, start_tick, end_tick)``: what each checkpoint, or one, adds to the one before.

    ``change`` is ``start`` for an edge that started since, with its end if
    that is known too, and ``end`` for one known before that ended since. Each
    interval is in two deltas at most, so all of them together are as large as
    the history; the starts and ends up to a checkpoint make it up.
    """
    rows = _stored(spark, path)
    known = F.when(~F.col("open") & (F.col("ended") == F.col("started")), F.col("end_tick")).otherwise(F.lit(OPEN))
    starts, ends = rows, rows.where(~F.col("open") & (F.col("ended") > F.col("started")))
    if checkpoint is not None:
        starts, ends = starts.where(F.col("started") == checkpoint), ends.where(F.col("ended") == checkpoint)
    starts = starts.select(F.col("started").alias("tick"), F.lit("start").alias("change"), "src", "dst", "start_tick", known.alias("end_tick"))
    return starts.unionByName(ends.select(F.col("ended").alias("tick"), F.lit("end").alias("change"), "src", "dst", "start_tick", "end_tick"))


def replace_open(edges: DataFrame, path: str, since: int, every: int = CHECKPOINT_EVERY) -> None:
    """Bring the store from tick ``since`` up to the history ``edges`` that goes on from there.

    ``edges`` has the intervals that ended after ``since`` and all open ones.
    The closed ones are added and only the directories of open edges are
    written anew; directories with closed intervals are not touched.
    """
    closed = edges.where((F.col("end_tick") > since) & (F.col("end_tick") != OPEN))
    write_intervals(closed, path, every, "append")
    still = edges.where(F.col("end_tick") == OPEN).select("src", "dst", "start_tick", "end_tick").withColumns({
        "started": checkpoint_tick(F.col("start_tick"), every), "ended": F.lit(None).cast("long"),
    })
    still.write.mode("overwrite").partitionBy("started", "ended").parquet(f"{path}/open=true")
