"""Snapshots on disk: Parquet partitioned by tick, and the legacy text layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.functions import triplet_text
from tidegraph.runtime import folder_numbers
from tidegraph.schema import EDGES, LABELLED_EDGES

# How the text layout writes a vertex and an edge.
VERTEX_LINE = r"^\(([+-]?[0-9]+),(.*)\)$"
INTERVAL_LINE = r"^Edge\(([+-]?[0-9]+),([+-]?[0-9]+),\(([0-9]+),([0-9]+)\)\)$"
LABELLED_LINE = r"^Edge\(([+-]?[0-9]+),([+-]?[0-9]+),(.*)\)$"


def write_snapshots(edges: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``edges`` carries a ``tick`` column; one directory per tick.

    Rows go to disk as they are partitioned. Gathering a tick in one task first
    would make fewer files and one task as large as the graph.
    """
    edges.write.mode(mode).partitionBy("tick").parquet(path)


def read_snapshot(spark: SparkSession, path: str, tick: int, labelled: bool = False) -> DataFrame:
    """One tick of the store; the other directories are pruned."""
    fields = (LABELLED_EDGES if labelled else EDGES).fields
    schema = T.StructType([*fields, T.StructField("tick", T.LongType())])
    return spark.read.schema(schema).parquet(path).where(F.col("tick") == tick).drop("tick")


def snapshot_ticks(spark: SparkSession, path: str) -> DataFrame:
    """The ticks in the store, from the names of its directories; no file is opened."""
    return spark.createDataFrame([(n,) for n in folder_numbers(spark, path, "tick")], "tick long")


def write_text_snapshot(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """Vertices ``(id,attr)`` and edges ``Edge(src,dst,(start,end))`` or with a label."""
    attr = (
        F.format_string("(%d,%d)", "start_tick", "end_tick") if "start_tick" in edges.columns else F.col("label")
    )
    vertices.select(
        F.concat(F.lit("("), F.col("id").cast("string"), F.lit(","), F.col("attr").cast("string"), F.lit(")"))
    ).write.text(f"{path}/vertices")
    edges.select(
        F.concat(
            F.lit("Edge("), F.col("src").cast("string"), F.lit(","), F.col("dst").cast("string"),
            F.lit(","), attr, F.lit(")"),
        )
    ).write.text(f"{path}/edges")


def read_text_vertices(spark: SparkSession, path: str, attr: int = 0) -> DataFrame:
    """The stored attribute is not kept: every vertex starts from ``attr``."""
    return (
        spark.read.text(f"{path}/vertices")
        .select(F.regexp_extract("value", VERTEX_LINE, 1).try_cast("long").alias("id"))
        .where("id IS NOT NULL")
        .withColumn("attr", F.lit(attr))
    )


def _groups(lines: DataFrame, pattern: str, casts: dict[str, str]) -> DataFrame:
    return lines.where(F.col("value").rlike(pattern)).select(
        *[
            F.regexp_extract("value", pattern, i).cast(kind).alias(name)
            for i, (name, kind) in enumerate(casts.items(), start=1)
        ]
    )


def read_text_intervals(spark: SparkSession, path: str) -> DataFrame:
    kinds = {"src": "long", "dst": "long", "start_tick": "long", "end_tick": "long"}
    return _groups(spark.read.text(f"{path}/edges"), INTERVAL_LINE, kinds)


def read_text_labelled(spark: SparkSession, path: str) -> DataFrame:
    kinds = {"src": "long", "dst": "long", "label": "string"}
    return _groups(spark.read.text(f"{path}/edges"), LABELLED_LINE, kinds)


def write_triplets(triplets: DataFrame, path: str) -> None:
    """One line ``((src,attr),(dst,attr),label)`` per triplet."""
    triplets.select(
        triplet_text(F.col("src"), F.col("src_attr"), F.col("dst"), F.col("dst_attr"), F.col("label"))
    ).write.text(path)


def write_dossiers(lines: DataFrame, path: str, tick: int) -> None:
    """The lines of ``vertex_dossier``, with those of a vertex next to each other.

    Range partitioning by the whole key lets a hub's lines run over several files.
    """
    keys = ["id", "section", "seq", "line"]
    ordered = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.write.mode("overwrite").parquet(f"{path}/tick={tick}")
