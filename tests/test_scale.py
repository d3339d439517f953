"""What a hot key does to the plans."""

import pytest
from pyspark.sql import functions as F

from tidegraph.operators import graph
from tidegraph.operators.activity import activity_log
from tidegraph.operators.compact import compact_batches
from tidegraph.operators.intervals import edge_intervals
from tidegraph.operators.static import fold_bag, fold_set
from tidegraph.runtime import shared_folder

SKEWED = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    # One merged partition would leave one task's output, which is not split.
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture
def small_thresholds(spark):
    before = {k: spark.conf.get(k, None) for k in SKEWED}
    for key, value in SKEWED.items():
        spark.conf.set(key, value)
    yield
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]


def hub_edges(spark):
    """Vertex 0 starts a third of all edges."""
    return spark.range(0, 60000, 1, 8).select(
        F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 5000).cast("long").alias("src"),
        (F.col("id") + 10000).alias("dst"),
        F.concat(F.lit("label"), F.col("id").cast("string")).alias("label"),
    )


def test_a_hub_is_split_in_vertex_joins(spark, small_thresholds):
    edges = hub_edges(spark)
    vertices = graph.from_edges(edges, F.lit("x"))
    plan = final_plan(graph.triplets(vertices, edges))
    assert "isSkew=true" in plan or "skewed" in plan


def test_a_hub_is_split_in_removals(spark, small_thresholds):
    edges = hub_edges(spark)
    vertices = graph.from_edges(edges, F.lit("x"))
    _, kept = graph.remove_nodes(vertices, edges, spark.range(1, 4000, 2))
    assert "skew" in final_plan(kept)


def _log(spark):
    """A hub adds a third of all edges, and every vertex is removed and added at times."""
    adds = hub_edges(spark).select(
        F.lit(1).cast("long").alias("tick"), F.col("dst").alias("pos"), F.lit("addEdge").alias("op"), "src", "label", "dst"
    )
    others = spark.range(0, 5000).select(
        (F.col("id") % 20 + 1).alias("tick"), F.col("id").alias("pos"),
        F.when(F.col("id") % 2 == 0, "rmvNode").otherwise("addNode").alias("op"),
        F.col("id").alias("src"), F.lit("").alias("label"), F.col("id").alias("dst"),
    )
    return adds.unionByName(others)


def test_a_hub_is_split_in_the_fold(spark, small_thresholds):
    assert "skew" in final_plan(edge_intervals(_log(spark)))


@pytest.mark.parametrize("run", [compact_batches, fold_set, activity_log], ids=lambda f: f.__name__)
def test_a_hub_is_split_elsewhere(spark, small_thresholds, run):
    assert "skew" in final_plan(run(_log(spark)))


def test_a_popular_edge_is_split(spark, small_thresholds):
    one = F.when(F.col("src") == 0, 0)
    log = _log(spark).withColumn("dst", F.coalesce(one, "dst")).withColumn("label", F.coalesce(one.cast("string"), "label"))
    found = fold_bag(log)
    assert "skew" in final_plan(found)
    assert found.where("src = 0 AND dst = 0").count() == log.where("op = 'addEdge' AND src = 0").count()


def test_filters_and_columns_reach_the_scan(spark):
    from tidegraph.plans.inputs import command_log

    plan = edge_intervals(command_log(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert scans and all("value" not in s and "props" not in s for s in scans)


def test_repeated_pairs_are_reduced_before_the_shuffle(spark):
    from tidegraph.operators.compact import last_per_pair
    from tidegraph.plans.inputs import command_log

    plan = last_per_pair(command_log(spark, "/root/testdata/sf0.001"))._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.index("partial_max")


def test_shared_folder_follows_the_setting(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_folder(spark) == (configured or spark.sparkContext.getCheckpointDir())


def test_activities_are_numbered_over_far_apart_positions(spark):
    from tidegraph.operators.activity import numbered

    rows = spark.range(0, 3000, 1, 4).select(F.lit(1).alias("k"), F.shiftleft("id", 33).alias("pos"))
    found = numbered(rows, "k", "pos", "n", chunk_rows=1 << 10)
    assert found.where(F.col("n") != F.shiftright("pos", 33) + 1).isEmpty() and found.count() == 3000
