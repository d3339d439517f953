"""The registered queries: ``(spark, sf_dir) -> DataFrame``."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators import activity, compact, graph, intervals, paths, static, timetravel
from tidegraph.plans import inputs
from tidegraph.plans.inputs import DEFAULT_NAME, LAST_TICK
from tidegraph.runtime import cut_lineage, scratch_path
from tidegraph.schema import CHECKPOINT_EVERY, OPEN
from tidegraph.sources import commands as command_source
from tidegraph.sources import edge_lists, interval_store, snapshots
from tidegraph.streaming.append import EdgeAppends
from tidegraph.streaming.dossiers import DossierStream
from tidegraph.streaming.fold import StreamingFold
from tidegraph.streaming.sequential import SequentialFold
from tidegraph.streaming.store import TickedStream, command_stream

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

ROOT = 1


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def _filled(commands: DataFrame) -> DataFrame:
    """Absent tokens as -1 and '', which compare the same in every engine."""
    return commands.na.fill(-1, ["src", "dst"]).na.fill("", ["label"])


def _history(spark: SparkSession, sf_dir: str, upto: int | None = None) -> DataFrame:
    return intervals.edge_intervals(inputs.command_log(spark, sf_dir), upto=upto)


# Text logs and edge lists


@query
def parse_commands(spark, sf_dir):
    return _filled(command_source.parse_commands(inputs.long_lines(spark, sf_dir)))


@query
def parse_commands_short(spark, sf_dir):
    return _filled(command_source.parse_commands_short(inputs.short_lines(spark, sf_dir)))


@query
def rejected_commands(spark, sf_dir):
    return command_source.rejected_commands(inputs.long_lines(spark, sf_dir))


@query
def rejected_commands_short(spark, sf_dir):
    return command_source.rejected_commands(inputs.short_lines(spark, sf_dir), short=True)


@query
def batch_directories(spark, sf_dir):
    """Through numbered directories on disk and a fold that depends on line order."""
    root = scratch_path(spark, "batches")
    command_source.write_batch_directories(inputs.long_lines(spark, sf_dir), root)
    lines = command_source.read_batch_directories(spark, root)
    return intervals.edge_intervals(command_source.parse_commands(lines))


@query
def edge_list_scan(spark, sf_dir):
    return edge_lists.parse_edge_list(inputs.order_lines(spark, sf_dir).select("value"))


@query
def edge_list_append(spark, sf_dir):
    return edge_lists.append_status(edge_lists.parse_edge_list(inputs.order_lines(spark, sf_dir)))


@query
def stream_edge_append(spark, sf_dir):
    """Orders land in numbered directories, a directory for each month, in three portions."""
    landing, lines = scratch_path(spark, "landing"), inputs.order_lines(spark, sf_dir).withColumn("pos", F.lit(0))
    appends = EdgeAppends(spark, scratch_path(spark, "appends"))
    for portion, months in enumerate(["tick < 23930", "tick BETWEEN 23930 AND 23959", "tick > 23959"]):
        command_source.write_batch_directories(lines.where(months), f"{landing}/portion-{portion}")
        appends.start(command_stream(spark, landing), availableNow=True).awaitTermination()
    return appends.status()


# Folding a log into intervals


@query
def batch_compact(spark, sf_dir):
    return compact.compact_batches(inputs.command_log(spark, sf_dir)).na.fill(-1, ["dst"])


@query
def edge_intervals(spark, sf_dir):
    return _history(spark, sf_dir)


@query
def edge_intervals_rta(spark, sf_dir):
    return intervals.edge_intervals(inputs.command_log(spark, sf_dir), "remove_then_add")


@query
def vertex_fold(spark, sf_dir):
    return intervals.vertex_fold(inputs.command_log(spark, sf_dir))


@query
def vertex_fold_rta(spark, sf_dir):
    return intervals.vertex_fold(inputs.command_log(spark, sf_dir), "remove_then_add")


@query
def graph_status(spark, sf_dir):
    log = _compacted(inputs.command_log(spark, sf_dir))
    return intervals.graph_status(intervals.edge_intervals(log), intervals.vertex_fold(log, "remove_then_add"))


def _compacted(log: DataFrame) -> DataFrame:
    """The log with what no tick cancels, worked out once; its vertices are folded as they stand."""
    return cut_lineage(compact.compact_batches(log).select("tick", "pos", "op", "src", "dst"))


def _streamed(spark: SparkSession, lines: DataFrame, fold: TickedStream) -> None:
    """The log arrives as files, ten days to a batch; each batch is one tick."""
    landing = scratch_path(spark, "landing")
    lines = lines.select(F.expr("(tick - 1) div 10").alias("batch"), "pos", "value")
    for batch in range((LAST_TICK - 1) // 10 + 1):
        (
            lines.where(F.col("batch") == batch)
            .repartitionByRange("pos").sortWithinPartitions("pos")
            .select("value").write.text(f"{landing}/{batch}")
        )
        fold.start(command_stream(spark, landing), availableNow=True).awaitTermination()


@query
def stream_fold(spark, sf_dir):
    fold = StreamingFold(spark, scratch_path(spark, "store"), every=2)
    _streamed(spark, inputs.long_lines(spark, sf_dir), fold)
    return fold.edges()


@query
def stream_batch_directories(spark, sf_dir):
    """Numbered directories that all lie there when the stream starts; each is a tick nevertheless."""
    root = scratch_path(spark, "batches")
    command_source.write_batch_directories(inputs.long_lines(spark, sf_dir), root)
    fold = StreamingFold(spark, scratch_path(spark, "store"), every=5, numbered=True)
    fold.start(command_stream(spark, root), availableNow=True).awaitTermination()
    return fold.edges()


@query
def stream_fold_set(spark, sf_dir):
    store = scratch_path(spark, "store")
    fold = SequentialFold(spark, store, "set", every=2, parse=command_source.parse_commands_short)
    _streamed(spark, inputs.short_lines(spark, sf_dir), fold)
    return fold.edges()


# Folding a log in order


@query
def static_fold_bag(spark, sf_dir):
    return static.fold_bag(inputs.command_log(spark, sf_dir))


@query
def static_fold_set(spark, sf_dir):
    return static.fold_set(inputs.command_log(spark, sf_dir))


@query
def static_vertices(spark, sf_dir):
    return static.present_vertices(inputs.command_log(spark, sf_dir))


@query
def named_vertices(spark, sf_dir):
    """Vertices with the names of the short dialect."""
    return static.named_vertices(command_source.parse_commands_short(inputs.short_lines(spark, sf_dir)), DEFAULT_NAME)


@query
def stream_restore(spark, sf_dir):
    """The in-order stream with restore commands before and after its first snapshot, in tick 2."""
    fold = SequentialFold(spark, scratch_path(spark, "store"), "bag", every=2)
    _streamed(spark, inputs.long_lines(spark, sf_dir), fold)
    return fold.edges()


@query
def stream_restore_numbered(spark, sf_dir):
    """The same log in four numbered directories of ten days that arrive at once, with restores between them."""
    root = scratch_path(spark, "batches")
    lines = inputs.long_lines(spark, sf_dir).withColumn("tick", F.expr("(tick - 1) div 10 + 1"))
    command_source.write_batch_directories(lines, root)
    fold = SequentialFold(spark, scratch_path(spark, "store"), "bag", every=2, numbered=True)
    fold.start(command_stream(spark, root), availableNow=True).awaitTermination()
    return fold.edges()


@query
def restore_nearest(spark, sf_dir):
    """After 20 days the graph goes back to the snapshot nearest to a time, then the log goes on."""
    log = inputs.command_log(spark, sf_dir)
    store = scratch_path(spark, "snapshots")
    lives = static.labelled_lifetimes(log)
    first = timetravel.checkpoint_tick(F.col("start_tick"))
    last = F.least(F.coalesce(F.col("end_tick") - 1, F.lit(LAST_TICK)), F.lit(LAST_TICK))
    ticks = F.sequence(first, last.cast("long"), F.lit(CHECKPOINT_EVERY).cast("long"))
    taken = lives.select("src", "dst", "label", F.explode(F.when(first <= last, ticks)).alias("tick"))
    snapshots.write_snapshots(taken, store)
    day = 24 * 3600 * 1000
    start = int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)
    times = snapshots.snapshot_ticks(spark, store).select(
        (F.lit(start) + F.col("tick") * day).alias("snapshot_ms"), "tick"
    )
    # Just before the first command of day 21.
    load = log.where("tick > 20").agg((F.min("pos") - 1).alias("pos")).select(
        "pos", F.lit("loadOld").alias("op"), F.lit("2024-01-12 07:00:00").alias("label")
    )
    return static.restore_then_fold(
        log.unionByName(load, allowMissingColumns=True),
        lambda tick: snapshots.read_snapshot(spark, store, tick, labelled=True),
        times,
    )


# Graph operators


@query
def graph_add_edges(spark, sf_dir):
    edges = inputs.supply_edges(spark, sf_dir)
    return graph.add_edges(edges.where("label = 'A'"), edges.where("label <> 'A'"))


@query
def graph_add_nodes(spark, sf_dir):
    nodes = inputs.supply_vertices(spark, sf_dir)
    return graph.add_nodes(nodes, nodes.withColumn("attr", F.concat("attr", F.lit("*"))))


@query
def graph_remove_edges(spark, sf_dir):
    edges = inputs.supply_edges(spark, sf_dir)
    return graph.remove_edges(edges, edges.where("label = 'R'").select("src", "dst").distinct())


@query
def graph_remove_nodes(spark, sf_dir):
    gone = (
        inputs.table(spark, sf_dir, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").alias("id"))
        .unionByName(
            inputs.table(spark, sf_dir, "part").where("p_size < 10")
            .select((F.col("p_partkey") + inputs.ID_OFFSET).alias("id"))
        )
    )
    vertices, edges = graph.remove_nodes(
        inputs.supply_vertices(spark, sf_dir), inputs.supply_edges(spark, sf_dir), gone
    )
    return _both(vertices, edges)


def _both(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """A graph as one table; a vertex has itself for both ends."""
    return edges.select(F.lit("edge").alias("part"), "src", "dst", "label").unionByName(
        vertices.select(
            F.lit("vertex").alias("part"), F.col("id").alias("src"), F.col("id").alias("dst"), F.col("attr").alias("label")
        )
    )


@query
def graph_from_edges(spark, sf_dir):
    return graph.from_edges(inputs.supply_edges(spark, sf_dir), F.lit(DEFAULT_NAME))


@query
def graph_apply(spark, sf_dir):
    """Customers and their orders, where only rich customers have a vertex row."""
    rich = inputs.table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("attr")
    )
    edges = edge_lists.parse_edge_list(inputs.order_lines(spark, sf_dir).select("value"))
    return graph.build_vertices(rich, edges, F.lit(DEFAULT_NAME))


@query
def edge_multiplicity(spark, sf_dir):
    return graph.edge_multiplicity(inputs.supply_edges(spark, sf_dir))


@query
def group_edges(spark, sf_dir):
    return graph.group_edges(inputs.supply_edges(spark, sf_dir))


@query
def label_runs(spark, sf_dir):
    return graph.label_runs(inputs.supply_edges(spark, sf_dir))


def _supply_triplets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.triplets(inputs.supply_vertices(spark, sf_dir), inputs.supply_edges(spark, sf_dir))


@query
def triplets(spark, sf_dir):
    return _supply_triplets(spark, sf_dir)


@query
def triplet_sentences(spark, sf_dir):
    return graph.sentences(_supply_triplets(spark, sf_dir))


@query
def incident_triplets(spark, sf_dir):
    return graph.incident_triplets(_supply_triplets(spark, sf_dir))


@query
def subgraph_edges(spark, sf_dir):
    return graph.subgraph_edges(
        _supply_triplets(spark, sf_dir), (F.col("label") != "R") & F.col("dst_attr").startswith("red")
    )


@query
def subgraph_vertices(spark, sf_dir):
    vertices, edges = graph.subgraph_vertices(
        inputs.supply_vertices(spark, sf_dir), inputs.supply_edges(spark, sf_dir), ~F.col("attr").startswith("red")
    )
    return _both(vertices, edges)


@query
def outer_join_vertices(spark, sf_dir):
    returned = (
        inputs.supply_edges(spark, sf_dir).where("label = 'R'").groupBy(F.col("src").alias("id"))
        .agg(F.count(F.lit(1)).alias("value"))
    )
    return graph.outer_join_vertices(inputs.supply_vertices(spark, sf_dir), returned, F.lit(0))


@query
def graph_equal(spark, sf_dir):
    """The graphs the two orders within a tick lead to, by their vertices and open pairs."""
    log = inputs.command_log(spark, sf_dir)

    def side(commands, mode):
        pairs = intervals.edge_intervals(commands, mode).where(F.col("end_tick") == OPEN).select("src", "dst")
        return intervals.vertex_fold(commands, "remove_then_add").select("id"), pairs

    return graph.graph_equal(side(_compacted(log), "last_wins"), side(log, "remove_then_add"))


@query
def activity_log(spark, sf_dir):
    return activity.activity_log(inputs.command_log(spark, sf_dir))


@query
def vertex_dossier(spark, sf_dir):
    return _dossier(inputs.command_log(spark, sf_dir))


def _dossier(log: DataFrame) -> DataFrame:
    vertices = static.present_vertices(log).withColumn("attr", F.concat(F.lit("user"), F.col("id").cast("string")))
    rows = graph.triplets(vertices, static.fold_set(log))
    return activity.vertex_dossier(vertices, rows, activity.activity_log(log))


@query
def triplet_dump(spark, sf_dir):
    """Triplets as lines of text, written and read back."""
    path = scratch_path(spark, "triplets")
    snapshots.write_triplets(_supply_triplets(spark, sf_dir), path)
    return spark.read.text(path)


@query
def dossier_store(spark, sf_dir):
    """Dossiers after a batch of fifteen days and after one without commands, which writes nothing."""
    log, path = inputs.command_log(spark, sf_dir), scratch_path(spark, "dossiers")
    for tick, batch in enumerate([log.where("tick <= 15"), log.where(F.col("tick") > LAST_TICK)], start=1):
        if not batch.isEmpty():
            snapshots.write_dossiers(_dossier(batch), path, tick)
    return spark.read.parquet(path).withColumn("tick", F.col("tick").cast("long"))


@query
def stream_dossiers(spark, sf_dir):
    """Fifteen days, a batch that is empty, two days, and one with two commands: each writes what it touches."""
    stream = DossierStream(spark, scratch_path(spark, "dossiers"), _dossier)
    lines, landing = inputs.long_lines(spark, sf_dir), scratch_path(spark, "landing")
    last = lines.where("tick = 18").agg(F.min("pos") + 4).scalar()
    portions = ["tick <= 15", "tick > 99", "tick IN (16, 17)", (F.col("tick") == 18) & (F.col("pos") <= last)]
    for portion, days in enumerate(portions):
        part = lines.where(days).where("value NOT LIKE 'loadOld%'")
        part.repartitionByRange("pos").sortWithinPartitions("pos").select("value").write.text(f"{landing}/{portion}")
        stream.start(command_stream(spark, landing), availableNow=True).awaitTermination()
    return stream.dossiers()


# Paths


@query
def bfs_hops(spark, sf_dir):
    return paths.bfs_hops(_history(spark, sf_dir), ROOT)


@query
def bfs_customer_chains(spark, sf_dir):
    """Customers in chains of forty, each hanging on vertex 0: paths longer than any usual bound on hops."""
    customers = inputs.table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("dst"))
    before = F.when((F.col("dst") - 1) % 40 == 0, F.lit(0)).otherwise(F.col("dst") - 1).cast("long")
    return paths.bfs_hops(customers.select(before.alias("src"), "dst"), 0)


@query
def bfs_incremental(spark, sf_dir):
    """The graph at the end of day 5, then the whole one; the early fold reads five days only."""
    earlier = paths.bfs_hops(_history(spark, sf_dir, upto=5), ROOT)
    return paths.bfs_incremental(_history(spark, sf_dir), earlier, ROOT, 2)


@query
def clock_arrival(spark, sf_dir):
    return paths.clock_arrival(_history(spark, sf_dir), ROOT)


@query
def window_clock_arrival(spark, sf_dir):
    seen = _history(spark, sf_dir, upto=timetravel.covering_checkpoint(18))
    return paths.window_clock_arrival(seen, ROOT, 4, 18)


@query
def earliest_arrival(spark, sf_dir):
    return paths.earliest_arrival(inputs.contacts(spark, sf_dir), ROOT, 1, 25)


@query
def temporal_fewest_hops(spark, sf_dir):
    return paths.fewest_hops(inputs.contacts(spark, sf_dir), ROOT, 1, 25)


# Snapshots and time travel


@query
def window_edges(spark, sf_dir):
    return timetravel.window_edges(_history(spark, sf_dir), 4, 18)


@query
def graph_as_of(spark, sf_dir):
    return timetravel.graph_as_of(_history(spark, sf_dir), 12)


@query
def checkpoints(spark, sf_dir):
    return timetravel.checkpoints(_history(spark, sf_dir), LAST_TICK)


def _interval_store(spark: SparkSession, sf_dir: str) -> str:
    """The history up to day 15, then the rest, which adds closed intervals and replaces the open edges."""
    path = scratch_path(spark, "intervals")
    interval_store.write_intervals(_history(spark, sf_dir, upto=15), path)
    interval_store.replace_open(_history(spark, sf_dir), path, since=15)
    return path


@query
def interval_store_as_of(spark, sf_dir):
    return interval_store.intervals_as_of(spark, _interval_store(spark, sf_dir), 12)


@query
def interval_store_checkpoint(spark, sf_dir):
    return interval_store.intervals_at(spark, _interval_store(spark, sf_dir), 20)


@query
def checkpoint_deltas(spark, sf_dir):
    return interval_store.checkpoint_deltas(spark, _interval_store(spark, sf_dir))


@query
def checkpoint_roundtrip(spark, sf_dir):
    store = scratch_path(spark, "checkpoints")
    seen = _history(spark, sf_dir, upto=15).withColumn("tick", F.lit(15).cast("long"))
    snapshots.write_snapshots(seen, store)
    return snapshots.read_snapshot(spark, store, 15)


@query
def text_snapshot_roundtrip(spark, sf_dir):
    log = inputs.command_log(spark, sf_dir)
    path = scratch_path(spark, "text-snapshot")
    early = log.where("tick <= 15")
    snapshots.write_text_snapshot(intervals.vertex_fold(early), intervals.edge_intervals(early), path)
    vertices = snapshots.read_text_vertices(spark, path).select(
        F.lit("vertex").alias("part"), F.col("id").alias("src"), F.col("id").alias("dst"),
        F.col("attr").cast("long").alias("start_tick"), F.col("attr").cast("long").alias("end_tick"),
    )
    return snapshots.read_text_intervals(spark, path).select(F.lit("edge").alias("part"), "*").unionByName(vertices)


@query
def labelled_text_roundtrip(spark, sf_dir):
    """The labelled graph of the in-order fold through the text layout."""
    log, path = inputs.command_log(spark, sf_dir), scratch_path(spark, "labelled-text")
    vertices = static.present_vertices(log).withColumn("attr", F.lit(1))
    snapshots.write_text_snapshot(vertices, static.fold_bag(log).select("src", "dst", "label"), path)
    return snapshots.read_text_labelled(spark, path)


@query
def nearest_snapshot(spark, sf_dir):
    """A snapshot in every hour that has events; the time lies half-way between two hours."""
    hours = inputs.table(spark, sf_dir, "events").select(
        (F.datediff(F.to_date("ts"), F.lit("1970-01-01")) * 24 + F.hour("ts")).cast("long").alias("tick")
    ).distinct()
    return timetravel.nearest_snapshot(
        hours.select((F.col("tick") * 3600000).alias("snapshot_ms"), "tick"), "2024-01-12 07:30:00"
    )
