"""Session helpers: the shared folder, lineage cuts and shuffle width."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.lookup import lookup

# Most rows a broadcast may have; a file list of that length takes some 50 MB.
SMALL_ROWS = 1 << 18


def local_session(name: str = "tidegraph", cores: str = "*", **conf: str) -> SparkSession:
    """A session for tests and the benchmark; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        # Tables of finished rounds are deleted once nothing refers to them.
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, from ``spark.checkpoint.dir``.

    Where the setting is absent it is a folder on the session's default file
    system. Only a local master may have that on its own disk: on a cluster its
    files would die with the executor.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if sc.getCheckpointDir() is None:
        if configured is None:
            home = spark._jvm.org.apache.hadoop.fs.FileSystem.get(spark._jsc.hadoopConfiguration()).getHomeDirectory()
            configured = f"{home.toString()}/.tidegraph"
            if configured.startswith("file:"):
                if not sc.master.startswith("local"):
                    raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
                configured = tempfile.mkdtemp(prefix="tidegraph-")
        sc.setCheckpointDir(configured)
    return configured or sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"


def _scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/tidegraph/{spark.sparkContext.applicationId}"


def clean_scratch(spark: SparkSession) -> None:
    """Delete what this application has left in the shared folder; its results cannot be read afterwards."""
    delete_folder(spark, _scratch(spark))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder, so a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_and_count(df: DataFrame, condition: Column | None = None) -> tuple[DataFrame, int]:
    """``cut_lineage``, counting on the way the rows that satisfy ``condition``."""
    seen = Observation()
    counted = F.count(F.lit(1) if condition is None else F.when(condition, 1))
    kept = cut_lineage(df.observe(seen, counted.alias("n")))
    return kept, seen.get["n"]


def join_small(facts: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join with a table of one row per ``keys`` that is small as a rule, such as a file list.

    It is written and counted first, and broadcast only if it is small indeed.
    """
    table, rows = cut_and_count(table)
    if rows <= SMALL_ROWS:
        return facts.join(F.broadcast(table), keys)
    return lookup(facts, table, keys, "inner")


class Rounds:
    """Tables of a loop in the shared folder, each deleted when no longer needed."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.folder = spark, scratch_path(spark, name)
        self.kept: dict[str, DataFrame] = {}

    def keep(self, df: DataFrame) -> tuple[DataFrame, int]:
        """``df`` written and read again, and its number of rows."""
        table, seen = self.keep_observed(df, n=F.count(F.lit(1)))
        return table, seen["n"]

    def keep_observed(self, df: DataFrame, **figures: Column) -> tuple[DataFrame, dict]:
        """``df`` written and read again, and aggregates of its rows that come with the writing."""
        seen = Observation()
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.observe(seen, *[figure.alias(name) for name, figure in figures.items()]).write.parquet(path)
        self.kept[path] = self.spark.read.schema(df.schema).parquet(path)
        return self.kept[path], seen.get

    def forget_all_but(self, *tables: DataFrame) -> None:
        for path in [p for p, own in self.kept.items() if not any(own is t for t in tables)]:
            del self.kept[path]
            delete_folder(self.spark, path)
        if not self.kept:
            delete_folder(self.spark, self.folder)


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of this library's own on any file system Spark can write to."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def folder_numbers(spark: SparkSession, path: str, key: str) -> list[int]:
    """The numbers n of the folders ``<key>=<n>`` in ``path``, from their names; no file is opened."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    names = [entry.getPath().getName() for entry in files.listStatus(root)]
    return sorted(int(name.removeprefix(f"{key}=")) for name in names if name.startswith(f"{key}="))
