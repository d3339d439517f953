"""Activity logs and per-vertex dossiers, one row per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidegraph.functions import triplet_text
from tidegraph.operators.graph import incident_triplets
from tidegraph.operators.lookup import lookup

CHUNK_ROWS = 1 << 20


def numbered(df: DataFrame, key: str, order: str, name: str, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Number the rows of each key from 1 in the order of a unique LONG column.

    A key may hold any share of the table, so it is never ranked in one piece.
    Its rows are cut into stretches of ``chunk_rows`` positions, which hold at
    most that many rows as positions are unique; each stretch is ranked by
    itself and starts after the rows of the stretches before it. Stretches are
    counted up the same way, in blocks, as positions may lie far apart.
    """
    chunked = df.withColumn("chunk", F.expr(f"{order} div {chunk_rows}"))
    counts = chunked.groupBy(key, "chunk").agg(F.count(F.lit(1)).alias("rows"))
    counts = counts.withColumn("block", F.expr(f"chunk div {chunk_rows}"))
    in_block = W.partitionBy(key, "block").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    blocks = W.partitionBy(key).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    before = counts.groupBy(key, "block").agg(F.sum("rows").alias("rows")).select(
        key, "block", F.coalesce(F.sum("rows").over(blocks), F.lit(0)).alias("before")
    )
    starts = counts.withColumn("start", F.coalesce(F.sum("rows").over(in_block), F.lit(0))).join(before, [key, "block"])
    starts = starts.select(key, "chunk", (F.col("start") + F.col("before")).alias("start"))
    place = F.row_number().over(W.partitionBy(key, "chunk").orderBy(order))
    return (
        chunked.withColumn("place", place)
        .join(starts, [key, "chunk"])
        .withColumn(name, (F.col("start") + F.col("place")).cast("long"))
        .drop("chunk", "place", "start")
    )


def activity_log(commands: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(id, seq, activity)``: the edges each vertex added since it was last added itself."""
    resets = (
        commands.where(F.col("op") == "addNode").groupBy("src").agg(F.max("pos").alias("reset"))
    )
    adds = commands.where(F.col("op") == "addEdge").select("pos", "src", "dst", "label")
    kept = (
        lookup(adds, resets, ["src"])
        .where(F.col("pos") > F.coalesce("reset", F.lit(-1)))
        .drop("reset")
    )
    # Fixed value: the wording of an activity.
    text = F.format_string("addE, (v%d, v%d, %s))", "src", "dst", "label")
    return numbered(kept, "src", "pos", "seq", chunk_rows).select(
        F.col("src").alias("id"), "seq", text.alias("activity")
    )


def vertex_dossier(vertices: DataFrame, triplet_rows: DataFrame, activities: DataFrame) -> DataFrame:
    """What there is to say about each vertex: itself, its edges, its activities.

    Returns ``(id, section, seq, line)``. A hub's dossier spans many rows and
    tasks instead of one record; ``seq`` orders activities and is 0 elsewhere,
    since the edges of a vertex have no order.
    """

    def lines(df: DataFrame, section: str, seq: Column, line: Column) -> DataFrame:
        return df.select("id", F.lit(section).alias("section"), seq.cast("long").alias("seq"), line.alias("line"))

    vertex = F.concat(F.lit("("), F.col("id").cast("string"), F.lit(","), F.col("attr").cast("string"), F.lit(")"))
    edge = triplet_text(F.col("src"), F.col("src_attr"), F.col("dst"), F.col("dst_attr"), F.col("label"))
    activity = F.concat(F.lit("a"), F.col("id").cast("string"), F.col("seq").cast("string"), F.lit(" = "), F.col("activity"))
    return (
        lines(vertices, "vertex", F.lit(0), vertex)
        .unionByName(lines(incident_triplets(triplet_rows), "edge", F.lit(0), edge))
        .unionByName(lines(lookup(activities, vertices.select("id"), ["id"], "left_semi"), "activity", F.col("seq"), activity))
    )
