"""What the streaming folds share: batches become ticks, ticks become versions.

Directories are named by tick or batch and overwritten, and a batch reads only
what earlier ticks wrote, so a batch that is replayed after a failure writes the
same again.

    log/tick=<t>/     compacted commands of the tick
    ticks/batch=<b>/  marks of the ticks that batch b became

A mark says when its tick was folded, the version it restored, how many ticks
there are with it, and the last version and the last full one by then. A batch
that writes a version repeats the earlier marks that are still needed; folders
before the last but one of that kind are deleted, so their number is bounded.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegraph.runtime import delete_folder, folder_numbers
from tidegraph.schema import CHECKPOINT_EVERY
from tidegraph.sources.commands import numbered_lines, parse_commands, with_place

MARKER = "tick long, snapshot_ms long, base long, nth long, version long, full long, own long, whole boolean"


def command_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Lines of new files under ``path``; without a limit, one batch takes all that is new."""
    reader = spark.readStream.option("recursiveFileLookup", "true")
    if files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_place(reader.text(path))


class TickedStream:
    """Runs a fold batch by batch; subclasses say what a batch and a version leave behind."""

    # Whether a tick may go back to a version, so that ticks are folded one by one and versions stay.
    restores = False

    def __init__(
        self,
        spark: SparkSession,
        store: str,
        every: int = CHECKPOINT_EVERY,
        parse: Callable[[DataFrame], DataFrame] = parse_commands,
        clock: Callable[[], float] = time.time,
        numbered: bool = False,
        retain: int | None = None,
    ):
        self.spark, self.store, self.every, self.parse, self.clock = spark, store.rstrip("/"), every, parse, clock
        # Whether a numbered directory is a tick, rather than a micro-batch.
        self.numbered = numbered
        # How many versions before the last keep what only they need; None keeps all. One
        # at least, for batches that are replayed and readers that have begun.
        if retain is not None and retain < 1:
            raise ValueError("one version before the last is needed")
        self.retain = retain
        self._last: tuple[int, Row] | None = None
        # Ticks of the batch in work, which has no marks yet.
        self._pending: list[Row] = []
        # Leaves a store that exists alone; a new one becomes readable.
        spark.createDataFrame([], MARKER).write.mode("ignore").parquet(f"{self.store}/ticks/batch=-1")

    def compacted(self, commands: DataFrame) -> DataFrame:
        """What the log keeps of the commands of one tick."""
        raise NotImplementedError

    def write_version(self, tick: int, last: Row, restored: int | None) -> int:
        """Fold the log since the version that ``last`` names; returns the last version written in full."""
        raise NotImplementedError

    def restored(self, commands: DataFrame, tick: int) -> int | None:
        """The version before ``tick`` its commands go back to, if any."""
        return None

    def start(self, lines: DataFrame, **trigger) -> StreamingQuery:
        """Run on ``command_stream``; pass e.g. ``availableNow=True`` or ``processingTime="15 seconds"``."""
        return (
            lines.writeStream.foreachBatch(self.apply)
            .option("checkpointLocation", f"{self.store}/progress")
            .trigger(**trigger)
            .start()
        )

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Fold one micro-batch. An empty one does not become a tick."""
        # The text is read once, for the ranks of its splits and for its lines.
        batch, self._pending = batch.persist(), []
        try:
            if batch.isEmpty():
                return
            if self.numbered:
                self._apply_numbered(batch, batch_id)
            else:
                self._apply_whole(batch, batch_id)
        finally:
            batch.unpersist()

    def _apply_whole(self, batch: DataFrame, batch_id: int) -> None:
        tick = self._last_mark(batch_id).tick + 1
        lines = numbered_lines(batch.withColumn("batch", F.lit(0))).withColumn("tick", F.lit(tick).cast("long"))
        commands = self.parse(lines).persist()
        try:
            self._fold_one_by_one(commands, [tick], batch_id)
        finally:
            commands.unpersist()

    def _apply_numbered(self, batch: DataFrame, batch_id: int) -> None:
        """Fold the directories of one micro-batch, each as the tick after its number.

        Only numbers that exist count: they may be far apart, and a version
        comes after every few of them. The driver sees one number for each
        directory. A file for a tick that an earlier micro-batch has folded is
        refused, as history would change.
        """
        before = self._last_mark(batch_id).tick
        lines = numbered_lines(batch.where("batch IS NOT NULL")).withColumn("tick", F.col("batch") + 1)
        commands = self.parse(lines).persist()
        try:
            ticks = sorted(r["tick"] for r in lines.select("tick").distinct().collect())
            if not ticks:
                return
            if ticks[0] <= before:
                raise ValueError(f"directory {ticks[0] - 1} has new files after tick {before} was folded")
            if self.restores:
                self._fold_one_by_one(commands, ticks, batch_id)
                return
            log = self.compacted(commands).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            log.partitionBy("tick").parquet(f"{self.store}/log")
        finally:
            commands.unpersist()
        for tick in ticks:
            self._pend(tick, None, batch_id)
        self._mark(batch_id)

    def _fold_one_by_one(self, commands: DataFrame, ticks: list[int], batch_id: int) -> None:
        """Each tick sees what those before it have left, in this batch too."""
        for tick in ticks:
            own = commands.where(F.col("tick") == tick)
            base = self.restored(own, tick)
            self.overwrite(self.compacted(own).drop("tick"), f"log/tick={tick}")
            self._pend(tick, base, batch_id)
        self._mark(batch_id)

    def _pend(self, tick: int, base: int | None, batch_id: int) -> None:
        """Count a tick whose log is written, with a version if one is due."""
        last = self._pending[-1] if self._pending else self._last_mark(batch_id)
        version, full = last.version, last.full
        if (last.nth + 1) % self.every == 0:
            version, full = tick, self.write_version(tick, last, base)
        now = int(self.clock() * 1000)
        self._pending.append(Row(
            tick=tick, snapshot_ms=now, base=base, nth=last.nth + 1, version=version, full=full, own=batch_id, whole=False
        ))

    def _mark(self, batch_id: int) -> None:
        # Last of all: a reader that sees the tick finds everything it needs.
        before, rows = self._last_mark(batch_id), self._pending
        marks = self.spark.createDataFrame(rows, MARKER)
        whole = rows[-1].version != before.version
        if whole:
            earlier = self._marks(batch_id)
            # A replay of this batch goes on from the version before it; snapshots can be asked for at any time.
            needed = F.col("tick") > before.version - 1
            if self.restores or self.retain is None:
                needed |= F.col("tick") == F.col("version")
            else:
                needed |= F.col("tick") >= self._kept_versions(earlier, before.version)
            marks = earlier.where(needed).drop("batch").unionByName(marks).withColumn("whole", F.lit(True))
        self.overwrite(marks.coalesce(1), f"ticks/batch={batch_id}")
        self._last, self._pending = (batch_id, rows[-1]), []
        if whole:
            self._forget(batch_id)

    def _kept_versions(self, marks: DataFrame, upto: int) -> int:
        """The earliest version that retention keeps, counted back from ``upto``."""
        versions = marks.where((F.col("tick") == F.col("version")) & (F.col("tick") <= upto)).select("tick").distinct()
        kept = versions.orderBy(F.desc("tick")).limit(self.retain + 1).collect()
        return kept[-1]["tick"] if len(kept) > self.retain else 0

    def _forget(self, batch_id: int) -> None:
        """Delete marks that are repeated later and, with ``retain``, logs and tables of earlier versions only."""
        marks = self._all_marks()
        repeated = marks.where(F.col("whole") & (F.col("batch") < batch_id)).agg(F.max("batch")).first()[0]
        if repeated is not None:
            self._delete_below("ticks", "batch", repeated)
        if self.retain is None:
            return
        marks = self._marks(None)
        kept = self._kept_versions(marks, self._last[1].version)
        if kept:
            # Readers of the earliest version that is kept go on from its own log.
            self._delete_below("log", "tick", kept + 1)
            full = marks.where(F.col("tick") == kept).agg(F.max("full")).first()[0]
            for name in self.only_for_later:
                self._delete_below(name, "version", full)

    # Tables of versions that no reader needs below the last full one.
    only_for_later: tuple[str, ...] = ()

    def _delete_below(self, name: str, key: str, least: int) -> None:
        for number in folder_numbers(self.spark, f"{self.store}/{name}", key):
            if number < least:
                delete_folder(self.spark, f"{self.store}/{name}/{key}={number}")

    def tick(self) -> int:
        return self._last_mark(None).tick

    def ticks(self) -> DataFrame:
        """Marks of the ticks that are still needed, those of the batch in work too."""
        marks = self._marks(None if not self._pending else self._pending[0].own).drop("batch")
        return marks.unionByName(self.spark.createDataFrame(self._pending, MARKER)) if self._pending else marks

    def overwrite(self, df: DataFrame, name: str, *partitions: str) -> None:
        df.write.mode("overwrite").partitionBy(*partitions).parquet(f"{self.store}/{name}")

    def _all_marks(self) -> DataFrame:
        return self.spark.read.schema(f"{MARKER}, batch long").parquet(f"{self.store}/ticks")

    def _marks(self, batch_id: int | None) -> DataFrame:
        """The marks made before ``batch_id``, or all: the last folder that repeats them and those since."""
        marks = self._all_marks()
        if batch_id is not None:
            marks = marks.where(F.col("batch") < batch_id)
        whole = marks.where("whole").agg(F.max("batch")).first()[0]
        return marks if whole is None else marks.where(F.col("batch") >= whole)

    def _last_mark(self, batch_id: int | None) -> Row:
        """The last tick before ``batch_id``, or of all; zeros where there is none."""
        if self._last is not None and (batch_id is None or self._last[0] < batch_id):
            return self._last[1]
        last = self._marks(batch_id).drop("batch").orderBy(F.desc("tick")).limit(1).collect()
        return last[0] if last else Row(tick=0, snapshot_ms=None, base=None, nth=0, version=0, full=0, own=-1, whole=False)
