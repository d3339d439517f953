"""Graphs and logs derived from the given tables, over their whole length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keeps the ids of parts and orders clear of those of suppliers and customers.
ID_OFFSET = 10**12
# Length of the log in days; the tick of a command is its day.
LAST_TICK = 31
# Fixed value: the name of a vertex that only edges imply.
DEFAULT_NAME = "John Doe"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def command_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as graph commands: ``(tick, pos, op, src, label, dst)``."""
    events = table(spark, sf_dir, "events")
    kind, event = F.col("event_type"), F.col("event_id")
    users = events.agg(F.max("user_id") + 1).scalar()
    return events.select(
        F.dayofmonth("ts").cast("long").alias("tick"),
        event.alias("pos"),
        F.when(kind.isin("click", "view"), "addEdge")
        .when(kind == "error", "rmvEdge")
        .when((kind == "purchase") & (event % 5 == 0), "rmvNode")
        .otherwise("addNode")
        .alias("op"),
        F.col("user_id").alias("src"),
        F.concat(F.lit("l"), (event % 3).cast("string")).alias("label"),
        ((F.col("user_id") * 7 + event % 5 + 1) % users).alias("dst"),
    )


def _text(*parts: Column | str) -> Column:
    return F.concat_ws(" ", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _with_noise(log: DataFrame, command: Column, extra: Column) -> DataFrame:
    """The command of every row, followed on some rows by another line."""
    noisy = F.when(F.col("pos") % 50 == 7, _text("bogus", F.col("src")))
    noisy = noisy.when(F.col("pos") % 50 == 17, _text(extra, F.col("src"), "l0"))
    noisy = noisy.when(F.col("pos") % 50 == 27, F.concat(F.lit("addNode x"), F.col("src").cast("string")))
    return log.select("tick", "pos", F.posexplode(F.array(command, noisy)).alias("turn", "value")).where(
        "value IS NOT NULL"
    ).select("tick", (F.col("pos") * 2 + F.col("turn")).alias("pos"), "value")


def _with_ignored(line: Column) -> Column:
    """On some rows a further word follows, too long for an id."""
    return F.when(F.col("pos") % 100 == 34, F.concat(line, F.lit(" 99999999999999999999"))).otherwise(line)


def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as text, with restore commands and lines that are no command."""
    log = command_log(spark, sf_dir)
    op, src, dst, label = F.col("op"), F.col("src"), F.col("dst"), F.col("label")
    line = (
        F.when(F.col("pos") % 500 == 9, F.lit("loadOld 2024-01-05 10:00:00"))
        .when(op.isin("addEdge", "rmvEdge"), _text(op, src, label, dst))
        .otherwise(_text(op, src))
    )
    return _with_noise(log, _with_ignored(line), F.lit("rmvEdge"))


def short_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in the short dialects: even positions the one, odd ones the other."""
    log = command_log(spark, sf_dir)
    op, src, dst, label = F.col("op"), F.col("src"), F.col("dst"), F.col("label")
    even = F.col("pos") % 2 == 0
    name = F.concat(F.lit("n"), src.cast("string"))
    line = (
        F.when(F.col("pos") % 500 == 9, F.lit("earliest"))
        .when(op == "addEdge", _text("addE", src, dst, label))
        .when(op == "rmvEdge", F.when(even, _text("delE", src, dst, label)).otherwise(_text("rmvE", src, dst)))
        .when(op == "addNode", _text("addN", src, name))
        .otherwise(F.when(even, _text("delN", src, name)).otherwise(_text("rmvN", src)))
    )
    return _with_noise(log, _with_ignored(line), F.lit("delE"))


def contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        command_log(spark, sf_dir).where("op = 'addEdge'")
        .select("src", "dst", F.col("tick").alias("t")).distinct()
    )


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as ``customer priority order`` lines, arriving by month."""
    return table(spark, sf_dir, "orders").select(
        (F.year("o_orderdate") * 12 + F.month("o_orderdate")).cast("long").alias("tick"),
        _text(
            F.col("o_custkey"), F.translate("o_orderpriority", " ", "_"), F.col("o_orderkey") + ID_OFFSET
        ).alias("value"),
    )


def supply_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as a multigraph from suppliers to parts, labelled by return flag."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("src"),
        (F.col("l_partkey") + ID_OFFSET).alias("dst"),
        F.col("l_returnflag").alias("label"),
    )


def supply_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("attr"))
    parts = table(spark, sf_dir, "part").select(
        (F.col("p_partkey") + ID_OFFSET).alias("id"), F.col("p_name").alias("attr")
    )
    return suppliers.unionByName(parts)
