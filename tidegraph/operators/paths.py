"""Path queries: one relaxation loop, several hops to a Spark job.

Only the size and time span of the graph, whether hubs exist, and how many
vertices changed or wait in a job come back to the driver.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegraph.functions import CLOCK_STEP, CONTACT_STEP, HOP_STEP
from tidegraph.operators.graph import endpoints
from tidegraph.operators.lookup import lookup
from tidegraph.operators.timetravel import checkpoint_at, covering_checkpoint, window_edges
from tidegraph.runtime import SMALL_ROWS, Rounds, cut_lineage

# Edges up to which a graph is kept in one partition, where a hop needs no shuffle.
FEW_EDGES = 1 << 17
# Out-edges from which on a vertex is a hub, whose edges are dealt out over partitions.
HUB_EDGES = 1 << 21
# Hops in one job, and the buckets a range of times is cut into at most.
HOPS_A_JOB, BUCKETS = 8, 16
# Tables of changed rows that may stand next to the merged one.
CHANGES_APART = 4


def _partitions(edge_count: int, configured: int) -> int:
    """As many partitions as the edges fill, at most the session's; one for a small graph.

    Every task of every hop reports its metrics to the driver, so a search in
    more tasks than its rows need sends more there than it finds.
    """
    return 1 if edge_count <= FEW_EDGES else max(1, min(configured, -(-edge_count // (2 * FEW_EDGES))))


# A row of the loop is a vertex with the best value offered so far. Its value
# and two marks are one number, ``code``: whose minimum prefers the lower value,
# then what has been sent on already, then what is stored already.
_WAITS, _NEW = 2, 1


class Relaxation:
    """Edges put in place for one or more searches with the same ``step``.

    Edges are partitioned and sorted by source once and stay in place; next to
    them each source has a row without a target, so that a left join with the
    edges gives a vertex back together with its offers. A hop joins what was
    reached with the edges, where it is, and shuffles the offers once, after
    taking the minimum of these per task. ``HOPS_A_JOB`` hops make one job,
    which writes only the vertices it changed; how many, and the least value
    still to be sent on, come with the writing. What is known stands in a few
    tables partitioned in the same way, merged when they are too many or as
    large as the merged one, and offers it beats are dropped at every hop.

    A vertex with more than ``hub_edges`` out-edges has its edges dealt out
    over as many slots as it needs, and is sent to all of them. Graphs of at
    most ``FEW_EDGES`` edges are in one partition and shuffle nothing. Larger
    ones have a partition for each ``2 * FEW_EDGES`` edges; the session's number
    of shuffle partitions is set to that while a job is written, so that its
    shuffles fit the edges, and put back. A hop sends no table through the
    driver: it broadcasts nothing but a list of hubs that was counted.
    """

    def __init__(self, edges: DataFrame, step: str, vertices: DataFrame | None = None, hub_edges: int = HUB_EDGES):
        self.spark, self.step = edges.sparkSession, step
        self.rounds = Rounds(self.spark, "relax")
        self.edges, self.edge_count = self.rounds.keep(edges)
        self.width = _partitions(self.edge_count, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        self.vertices, self.hubs = vertices, None
        self.views: list[str] = []
        rows = self.edges
        ends = rows.select("src").distinct()
        if self.edge_count > hub_edges:
            slots = F.ceil(F.col("degree") / hub_edges).cast("int").alias("slots")
            hubs = rows.groupBy("src").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > hub_edges)
            hubs, count = self.rounds.keep(hubs.select("src", slots))
            if count:
                self.hubs, self.few_hubs = hubs, count <= SMALL_ROWS
                self.hubs_view = self._view(hubs)
                slot = F.pmod(F.xxhash64("dst"), F.coalesce("slots", F.lit(1))).cast("int")
                rows = lookup(rows, hubs, ["src"]).withColumn("slot", slot).drop("slots")
                ends = ends.withColumn("slot", F.lit(0))
        rows = rows.unionByName(ends, allowMissingColumns=True)
        self.tables = [self.edges] + [t for t in [self.hubs] if t is not None]
        self.results: list[DataFrame] = []
        keys = ["src"] if self.hubs is None else ["src", "slot"]
        self.placed = self._in_place(rows, *keys).sortWithinPartitions(*keys).persist(StorageLevel.MEMORY_AND_DISK)
        # A cached table says how it is partitioned once it has been filled.
        self.placed.count()
        self.placed_view = self._view(self.placed)

    def __enter__(self) -> Relaxation:
        return self

    def __exit__(self, *_) -> None:
        for view in self.views:
            self.spark.catalog.dropTempView(view)
        self.placed.unpersist()
        # What a search found is read from its last tables.
        self.rounds.forget_all_but(*self.results)

    def _view(self, table: DataFrame) -> str:
        """A name for ``table`` in SQL, its own to the end: dropping or replacing it would drop what is cached."""
        name = f"relax_{uuid.uuid4().hex}"
        table.createTempView(name)
        self.views.append(name)
        return name

    @contextmanager
    def _shuffles_in_place(self) -> Iterator[None]:
        """Shuffles planned meanwhile have the partitions of the edges."""
        name, conf = "spark.sql.shuffle.partitions", self.spark.conf
        before = conf.get(name)
        conf.set(name, str(self.width))
        try:
            yield
        finally:
            conf.set(name, before)

    def _in_place(self, rows: DataFrame, *keys: str) -> DataFrame:
        return rows.coalesce(1) if self.width == 1 else rows.repartition(self.width, *keys)

    def _hop(self, reached: DataFrame, known: list[str]) -> DataFrame:
        """``reached`` and what it offers, the best of every vertex.

        A merge join reads both sides where they are, in order. Without the
        hint Spark may find a side small enough to broadcast, and would collect
        it anew at every hop. Offers no better than in one of the ``known``
        tables are dropped; ``held`` is the best value there.
        """
        rows = "SELECT *, shiftright(code, 2) AS value, code & 2 <> 0 AND shiftright(code, 2) < bound AS sent FROM "
        rows += self._view(reached)
        meets = "g.id = e.src AND g.sent"
        if self.hubs is not None:
            slots = "explode(CASE WHEN g.sent AND h.slots IS NOT NULL THEN sequence(0, h.slots - 1) ELSE array(0) END)"
            few = "/*+ BROADCAST(h) */" if self.few_hubs else ""
            joined = f"SELECT {few} g.*, {slots} AS at FROM ({rows}) g LEFT JOIN {self.hubs_view} h ON g.id = h.src"
            rows = f"SELECT /*+ REPARTITION({self.width}, id, at) */ * FROM ({joined})"
            meets += " AND g.at = e.slot"
        best = f"""
            SELECT id, min(code) AS code, min(hops) AS hops, max(bound) AS bound, max(level) AS level FROM (
                SELECT /*+ MERGE(e) */ coalesce(e.dst, g.id) AS id, bound, level + 1 AS level,
                       CASE WHEN e.dst IS NOT NULL THEN shiftleft({self.step}, 2) + {_WAITS | _NEW}
                            WHEN g.sent THEN code - {_WAITS} ELSE code END AS code,
                       CASE WHEN e.dst IS NOT NULL THEN level + 1 ELSE hops END AS hops
                FROM ({rows}) g LEFT JOIN {self.placed_view} e ON {meets})
            WHERE code IS NOT NULL GROUP BY id"""
        if not known:
            return self.spark.sql(best)
        held = ", ".join(f"{table}.value" for table in known)
        tables = " ".join(f"LEFT JOIN {table} ON b.id = {table}.id" for table in known)
        best = f"SELECT /*+ MERGE({', '.join(known)}) */ b.*, {f'least({held})' if len(known) > 1 else held} AS held FROM ({best}) b {tables}"
        return self.spark.sql(f"SELECT * FROM ({best}) WHERE held IS NULL OR code & {_NEW} = 0 OR shiftright(code, 2) < held")

    def _job(self, pending: DataFrame, bound: int, done: int, hops: int, known: list[str]) -> DataFrame:
        """What ``pending`` reaches in some hops after ``done``, where values below ``bound`` are sent on.

        The level goes with the rows, as a vertex may be sent on again after
        the hop that reached it.
        """
        code = F.shiftleft("value", 2) + _WAITS
        fixed = {"bound": bound, "level": done}
        rows = self._in_place(pending.where("waits"), "id").select(
            "id", code.alias("code"), "hops", *[F.lit(x).cast("long").alias(name) for name, x in fixed.items()]
        )
        for k in range(hops):
            # One partition holds little: there what is known is looked up once, at the end.
            rows = self._hop(rows, known if self.width > 1 or k == hops - 1 else [])
            rows = rows if k == hops - 1 or self.width == 1 else rows.drop("held")
        return rows.selectExpr(
            "id", "shiftright(code, 2) AS value", "hops", f"code & {_WAITS} <> 0 AS waits", f"code & {_NEW} <> 0 AS new",
            "held IS NULL AS first",
        )

    def run(
        self, sources: DataFrame, max_hops: int | None = None, bucket: int | None = None, enough: int | None = None
    ) -> DataFrame:
        """``(id, value, hops)`` of the vertices reached from ``sources(id, value)``.

        Without ``bucket`` all that changed in a hop is sent on in the next
        one, so ``hops`` is the fewest edges to a vertex, and ``max_hops`` can
        bound it. With ``bucket`` the search goes by value: a job sends on the
        vertices below a bound and settles them for good, as a step gives at
        least one more; then the bound moves on from the least value that
        waits. ``hops`` means nothing then. ``enough`` ends the search once so
        many vertices are reached.
        """
        rounds = self.rounds
        start = sources.where("value IS NOT NULL").select("id", F.col("value").cast("long"))
        ids = self.edges.select(F.col("src").alias("id")).union(self.edges.select("dst"))
        if self.vertices is not None:
            ids = ids.union(self.vertices.select("id"))
        start = ids.join(start, "id").groupBy("id").agg(F.min("value").alias("value"))
        start = start.select("id", "value", F.lit(0).cast("long").alias("hops"), F.lit(True).alias("waits"), F.lit(False).alias("new"))
        pending, seen = rounds.keep_observed(start, n=F.count(F.lit(1)), low=F.min("value"))
        waiting, low, reached, done, bound = seen["n"], seen["low"], seen["n"], 0, None
        own, known = [(pending, waiting)], [self._known_again(pending)]
        names = [self._view(known[0])]
        while waiting and (max_hops is None or done < max_hops) and (enough is None or reached < enough):
            hops = HOPS_A_JOB if max_hops is None else min(HOPS_A_JOB, max_hops - done)
            if bucket is None:
                bound = 1 << 60
            elif bound is None or low >= bound:
                bound = low + bucket
            waits, new = F.col("waits"), F.col("new")
            with self._shuffles_in_place():
                pending, seen = rounds.keep_observed(
                    self._job(pending, bound, done, hops, names), n=F.count_if(waits), low=F.min(F.when(waits, F.col("value"))), changed=F.count_if(new),
                    first=F.count_if(new & F.col("first")),
                )
            waiting, low, done = seen["n"], seen["low"], done + hops
            reached += seen["first"]
            own.append((pending, seen["changed"]))
            known.append(self._known_again(pending.where("new")))
            names.append(self._view(known[-1]))
            if len(own) > CHANGES_APART or sum(n for _, n in own[1:]) > own[0][1] > FEW_EDGES:
                with self._shuffles_in_place():
                    merged, count = rounds.keep(self._best([t if k == 0 else t.where("new") for k, (t, _) in enumerate(own)]))
                for table in known:
                    table.unpersist()
                own, known = [(merged, count)], [self._known_again(merged)]
                names = [self._view(known[0])]
                rounds.forget_all_but(*self.tables, *self.results, pending, merged)
        for table in known:
            table.unpersist()
        self.results += [table for table, _ in own]
        return self._best([t if k == 0 else t.where("new") for k, (t, _) in enumerate(own)])

    def _known_again(self, table: DataFrame) -> DataFrame:
        """A stored table in place: read where it is used, in one partition; else dealt out once and kept."""
        placed = self._in_place(table.select("id", "value", "hops"), "id")
        return placed if self.width == 1 else placed.sortWithinPartitions("id").persist(StorageLevel.MEMORY_AND_DISK)

    @staticmethod
    def _best(tables: list[DataFrame]) -> DataFrame:
        rows = tables[0].select("id", "value", "hops")
        for more in tables[1:]:
            rows = rows.unionByName(more.select("id", "value", "hops"))
        return rows.groupBy("id").agg(F.min("value").alias("value"), F.min("hops").alias("hops"))


def relax(
    edges: DataFrame,
    sources: DataFrame,
    step: str,
    max_hops: int | None = None,
    vertices: DataFrame | None = None,
    hub_edges: int = HUB_EDGES,
    bucket: int | None = None,
) -> DataFrame:
    """Least value of every vertex over all paths, or those of at most ``max_hops`` edges.

    ``sources`` is ``(id, value)``; a source that is in neither ``edges`` nor
    ``vertices`` counts for nothing. ``step`` gives the value at the far end of
    an edge from the ``value`` at its near end and the edge's columns, or NULL
    if the edge cannot be used; it must give more than ``value``, not fall as
    that grows, and stay below 2**60. Returns ``(id, value, hops)`` of the
    vertices reached; ``hops`` and ``bucket`` are explained with
    ``Relaxation.run``.
    """
    if bucket is not None and max_hops is not None:
        raise ValueError("paths are bounded in hops by level, not by bucket")
    with Relaxation(edges, step, vertices, hub_edges) as search:
        return search.run(sources, max_hops, bucket)


def _from(edges: DataFrame, root: int, value: int) -> DataFrame:
    return edges.sparkSession.range(root, root + 1).select("id", F.lit(value).cast("long").alias("value"))


def _bucket(edges: DataFrame, time: str) -> int:
    """Times a job should settle: what its hops settle for certain, or a share of the whole range."""
    span = edges.agg(F.max(time) - F.min(time)).first()[0] or 0
    # A multiple of the hops, so that no job is cut short by the bound.
    return max(1, -(-span // (BUCKETS * HOPS_A_JOB))) * HOPS_A_JOB


def bfs_hops(edges: DataFrame, root: int, max_hops: int | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """``(id, hops)`` of every vertex the root reaches along edge direction."""
    pairs = edges.select("src", "dst").distinct()
    return relax(pairs, _from(edges, root, 0), HOP_STEP, max_hops, vertices).select("id", F.col("value").alias("hops"))


def bfs_incremental(
    edges: DataFrame,
    earlier: DataFrame,
    root: int,
    iteration: int,
    max_hops: int | None = None,
    vertices: DataFrame | None = None,
) -> DataFrame:
    """Earlier hops ``(id, hops)`` carried onto a changed graph.

    Every vertex with an earlier result restarts at ``iteration``; the lesser of
    the earlier and the new value stays.
    """
    start = F.lit(iteration).cast("long").alias("value")
    held = (
        earlier.where((F.col("id") != root) & F.col("hops").isNotNull())
        .select("id", F.col("hops").cast("long").alias("before"))
        .unionByName(_from(edges, root, 0).withColumnRenamed("value", "before"))
    )
    held = cut_lineage(held)
    pairs = edges.select("src", "dst").distinct()
    found = relax(pairs, held.select("id", start), HOP_STEP, max_hops, vertices)
    return found.join(held, "id", "left").select("id", F.least("value", "before").alias("hops"))


def clock_arrival(edges: DataFrame, root: int, max_hops: int | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """``(id, arrival)`` over interval edges, leaving the root at time 0.

    Vertices are settled by buckets of arrival, each in as many jobs as it has
    paths of ``HOPS_A_JOB`` edges, so none is sent on again once it is final.
    With ``max_hops`` the search goes by level.
    """
    usable = edges.select("src", "dst", "start_tick", "end_tick")
    with Relaxation(usable, CLOCK_STEP, vertices) as search:
        bucket = _bucket(search.edges, "start_tick") if max_hops is None else None
        return search.run(_from(edges, root, 0), max_hops, bucket).select("id", F.col("value").alias("arrival"))


def _usable(contacts: DataFrame, first: int, last: int) -> DataFrame:
    """Contacts that can lie on a path within ``[first, last]``."""
    t = F.col("t")
    return contacts.where((t >= first) & (t + 1 <= last)).select("src", "dst", "t").distinct()


def earliest_arrival(contacts: DataFrame, root: int, first: int, last: int, vertices: DataFrame | None = None) -> DataFrame:
    """``(id, arrival)`` over contacts, from ``first`` at the root to ``last`` at most.

    Time goes by in slices: a job settles all arrivals within one, so the jobs
    follow the time there is and not the length of paths, and each contact is
    used once.
    """
    with Relaxation(_usable(contacts, first, last), CONTACT_STEP, vertices) as search:
        found = search.run(_from(contacts, root, first), bucket=_bucket(search.edges, "t"))
        return found.select("id", F.col("value").alias("arrival"))


def fewest_hops(contacts: DataFrame, root: int, first: int, last: int, vertices: DataFrame | None = None) -> DataFrame:
    """``(id, hops)`` of the time-respecting path with the fewest contacts.

    Level by level a vertex keeps its earliest arrival, which no pair of more
    hops and a later arrival beats; an earlier one is sent on even from a vertex
    reached before, as it may open a path. The level that first reaches a
    vertex gives the answer, so the search ends when nothing has changed, or
    with every vertex reached that any contact leads to.
    """
    start = _from(contacts, root, first)
    with Relaxation(_usable(contacts, first, last), CONTACT_STEP, vertices) as search:
        everyone = search.edges.select("dst").union(start.select("id")).distinct().count()
        return search.run(start, enough=everyone).select("id", "hops")


def window_clock_arrival(
    edges: DataFrame, root: int, t1: int, t2: int, max_hops: int | None = None, vertices: DataFrame | None = None
) -> DataFrame:
    """Clock arrival over edges started in ``[t1, t2)``, as the checkpoint after ``t2`` saw them.

    The window leaves no edge out of the vertex set, so the root counts as long
    as any edge of the checkpoint touches it.
    """
    seen = checkpoint_at(edges, covering_checkpoint(t2))
    if vertices is None:
        vertices = endpoints(seen.where((F.col("src") == root) | (F.col("dst") == root)))
    return clock_arrival(window_edges(seen, t1, t2), root, max_hops, vertices)
