import random
import re

import pytest
from bruteforce import OPEN, relax, rows

from tidegraph.functions import CLOCK_STEP, HOP_STEP
from tidegraph.operators import paths


def clock(x, edge):
    _, _, start, end = edge
    return start + 1 if x <= start else x + 1 if x <= end else None


def contact(x, edge):
    return edge[2] + 1 if edge[2] >= x else None


def random_intervals(rng, vertices, count):
    found = []
    for _ in range(count):
        start = rng.randint(1, 20)
        found.append((rng.randrange(vertices), rng.randrange(vertices), start, rng.choice([start + 2, start + 9, OPEN])))
    return found


@pytest.fixture(scope="module", params=[1, 2])
def intervals(request, spark):
    edges = random_intervals(random.Random(request.param), 40, 90)
    return edges, spark.createDataFrame(edges, "src long, dst long, start_tick long, end_tick long")


@pytest.mark.parametrize("hops", [2, 20])
def test_clock(intervals, hops):
    edges, frame = intervals
    best, _ = relax(edges, {1: 0}, clock, hops)
    in_graph = {v for e in edges for v in e[:2]}
    expected = sorted((v, x) for v, x in best.items() if v in in_graph)
    assert rows(paths.clock_arrival(frame, 1, hops)) == expected


def test_hubs_are_set_apart_without_changing_the_answer(intervals):
    edges, frame = intervals
    found = paths.relax(frame, paths._from(frame, 1, 0), CLOCK_STEP, 20, hub_edges=3)
    best, hops = relax(edges, {1: 0}, clock, 20)
    assert rows(found.where("value IS NOT NULL")) == sorted((v, x, hops[v]) for v, x in best.items() if v in {v for e in edges for v in e[:2]})


def test_bfs(intervals):
    edges, frame = intervals
    best, _ = relax(edges, {1: 0}, lambda x, e: x + 1, 20)
    in_graph = {v for e in edges for v in e[:2]}
    assert rows(paths.bfs_hops(frame, 1)) == sorted((v, x) for v, x in best.items() if v in in_graph)


@pytest.mark.parametrize("iteration", [0, 2])
def test_incremental_bfs(spark, intervals, iteration):
    edges, frame = intervals
    in_graph = {v for e in edges for v in e[:2]}
    earlier = {1: 0, 2: 1, 3: 9, 999: 4}
    before = spark.createDataFrame(sorted(earlier.items()), "id long, hops long")
    best, _ = relax(edges, {v: iteration for v in earlier if v in in_graph}, lambda x, e: x + 1, 20)
    expected = sorted((v, min(x, earlier.get(v, x))) for v, x in best.items())
    assert rows(paths.bfs_incremental(frame, before, 1, iteration)) == expected


@pytest.mark.parametrize("seed", [4, 5])
def test_contacts(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(30), rng.randrange(30), rng.randint(1, 30)) for _ in range(150)]
    frame = spark.createDataFrame(edges, "src long, dst long, t long")
    usable = [e for e in edges if 3 <= e[2] <= 24]
    best, hops = relax(usable, {1: 3}, contact, 100)
    assert rows(paths.earliest_arrival(frame, 1, 3, 25)) == sorted(best.items())
    assert rows(paths.fewest_hops(frame, 1, 3, 25)) == sorted(hops.items())


def test_same_tick_contacts_do_not_chain(spark):
    frame = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (2, 4, 6)], "src long, dst long, t long")
    assert rows(paths.earliest_arrival(frame, 1, 1, 9)) == [(1, 1), (2, 6), (4, 7)]


def test_interval_end_is_usable(spark):
    frame = spark.createDataFrame(
        [(1, 2, 4, 9), (2, 3, 1, 5), (2, 4, 1, 4)], "src long, dst long, start_tick long, end_tick long"
    )
    assert rows(paths.clock_arrival(frame, 1)) == [(1, 0), (2, 5), (3, 6)]


def test_absent_root_reaches_nothing(spark):
    frame = spark.createDataFrame([(1, 2, 1, OPEN)], "src long, dst long, start_tick long, end_tick long")
    assert rows(paths.clock_arrival(frame, 77)) == []


def test_isolated_root_reaches_itself(spark):
    frame = spark.createDataFrame([(1, 2, 1, OPEN)], "src long, dst long, start_tick long, end_tick long")
    alone = spark.createDataFrame([(77,)], "id long")
    assert rows(paths.clock_arrival(frame, 77, vertices=alone)) == [(77, 0)]


def test_empty_graph(spark):
    frame = spark.createDataFrame([], "src long, dst long, start_tick long, end_tick long")
    assert rows(paths.bfs_hops(frame, 1)) == []


def test_window_reads_the_covering_checkpoint(spark):
    # Closings after tick 5 are not known to the checkpoint a window to 4 reads.
    frame = spark.createDataFrame(
        [(1, 2, 2, 3), (2, 3, 1, 2), (2, 4, 1, 9), (1, 5, 4, 8)],
        "src long, dst long, start_tick long, end_tick long",
    )
    assert rows(paths.window_clock_arrival(frame, 1, 1, 4)) == [(1, 0), (2, 3), (4, 4)]
    assert rows(paths.window_clock_arrival(frame, 1, 4, 5)) == [(1, 0), (5, 5)]


@pytest.fixture
def wide(spark, monkeypatch):
    """Graphs count as large from 30 edges on."""
    monkeypatch.setattr(paths, "FEW_EDGES", 30)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.fixture
def jobs(monkeypatch):
    """The plan and the figures of every table a loop writes."""
    from tidegraph import runtime

    written = []
    keep = runtime.Rounds.keep_observed

    def watched(self, df, **figures):
        plan = df._jdf.queryExecution().executedPlan().toString()
        table, seen = keep(self, df, **figures)
        written.append((self, plan, seen))
        return table, seen

    monkeypatch.setattr(runtime.Rounds, "keep_observed", watched)
    return written


def test_edges_stay_in_place_between_hops(spark, wide, jobs):
    """A hop joins the cached edges where they are and shuffles its offers once."""
    edges = random_intervals(random.Random(9), 40, 100)
    frame = spark.createDataFrame(edges, "src long, dst long, start_tick long, end_tick long")
    paths.clock_arrival(frame, edges[0][0])
    plans = [plan for _, plan, seen in jobs if "changed" in seen]
    assert plans
    for plan in plans:
        lines = plan.splitlines()
        joins = [k for k, line in enumerate(lines) if "SortMergeJoin" in line and "src#" in line]
        assert len(joins) == paths.HOPS_A_JOB
        for join in joins:
            deep = lines[join].index("SortMergeJoin")
            below = next(k for k in range(join + 1, len(lines)) if lines[k][deep : deep + 2] == "+-")
            below += "Filter isnotnull" in lines[below]
            assert "InMemoryTableScan" in lines[below]


def test_large_graphs_give_the_same(spark, wide):
    """Over several partitions, with and without hubs, by level and by bucket."""
    rng = random.Random(12)
    edges = random_intervals(rng, 60, 400) + [(5, k, rng.randint(1, 20), OPEN) for k in range(60)]
    frame = spark.createDataFrame(edges, "src long, dst long, start_tick long, end_tick long")
    best, hops = relax(edges, {1: 0}, clock, 100)
    expected = sorted(best.items())
    for hub_edges in (paths.HUB_EDGES, 9):
        found = paths.relax(frame, paths._from(frame, 1, 0), CLOCK_STEP, hub_edges=hub_edges)
        assert rows(found) == sorted((v, x, hops[v]) for v, x in best.items())
        found = paths.relax(frame, paths._from(frame, 1, 0), CLOCK_STEP, hub_edges=hub_edges, bucket=3)
        assert rows(found.select("id", "value")) == expected


def test_settled_vertices_are_not_sent_again(spark, jobs):
    """By bucket, an arrival is written once per vertex but for those that wait."""
    rng = random.Random(2)
    edges = random_intervals(rng, 300, 3000)
    frame = spark.createDataFrame(edges, "src long, dst long, start_tick long, end_tick long")
    best, _ = relax(edges, {1: 0}, clock, 100)
    assert rows(paths.clock_arrival(frame, 1)) == sorted(best.items())
    written = [seen for _, _, seen in jobs if "changed" in seen]
    assert [seen["low"] for seen in written] == sorted((seen["low"] for seen in written), key=lambda x: (x is None, x))
    assert sum(seen["first"] for seen in written) == len(best) - 1


def test_a_long_path_of_contacts_takes_few_jobs(spark, jobs):
    frame = spark.createDataFrame([(k, k + 1, k + 1) for k in range(200)], "src long, dst long, t long")
    assert rows(paths.earliest_arrival(frame, 0, 1, 300)) == [(0, 1)] + [(k, k + 1) for k in range(1, 201)]
    assert sum("changed" in seen for _, _, seen in jobs) <= 200 / paths.HOPS_A_JOB + 3


def test_times_far_apart_take_no_more_jobs_than_buckets(spark, jobs):
    hour = 3_600_000
    frame = spark.createDataFrame([(k, k + 1, 1_700_000_000_000 + k * hour) for k in range(30)], "src long, dst long, t long")
    found = paths.earliest_arrival(frame, 0, 0, 2_000_000_000_000)
    assert rows(found)[-1] == (30, 1_700_000_000_001 + 29 * hour)
    assert len(jobs) <= 2 + paths.BUCKETS * 1.5


def test_an_earlier_arrival_at_a_reached_vertex_opens_a_path(spark):
    # Vertex 3 is reached first by one hop, late; only the way by 2 is in time for the contact at 5.
    frame = spark.createDataFrame([(1, 3, 8), (1, 2, 1), (2, 3, 3), (3, 4, 5)], "src long, dst long, t long")
    assert rows(paths.fewest_hops(frame, 1, 1, 20)) == [(1, 0), (2, 1), (3, 1), (4, 3)]


def test_settings_are_put_back(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    frame = spark.createDataFrame([(1, 2)], "src long, dst long")
    paths.bfs_hops(frame, 1)
    assert before == (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled"))


def test_long_chains_are_followed_to_their_end(spark):
    edges = spark.createDataFrame([(k, k + 1, 1, OPEN) for k in range(40)], "src long, dst long, start_tick long, end_tick long")
    assert rows(paths.bfs_hops(edges, 0)) == [(k, k) for k in range(41)]
    assert rows(paths.bfs_hops(edges, 0, max_hops=20)) == [(k, k) for k in range(21)]
    assert len(rows(paths.clock_arrival(edges, 0))) == 41


def test_loops_use_the_sessions_width_and_leave_its_settings_alone(spark):
    assert paths._partitions(10**12, 2000) == 2000
    assert paths._partitions(1000, 2000) == 1
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    edges = spark.createDataFrame([(k, (k * 7 + 1) % 50) for k in range(50)], "src long, dst long")
    paths.bfs_hops(edges, 0).collect()
    assert before == {k: spark.conf.get(k) for k in before}


def test_jobs_write_changed_rows_and_are_deleted(spark, jobs):
    edges = spark.createDataFrame([(k, k + 1) for k in range(12)] + [(0, k) for k in range(100, 400)], "src long, dst long")
    found = paths.bfs_hops(edges, 0)
    assert found.count() == 313
    # The edges, the root, eight hops, the next four, and one job that finds nothing more.
    changed = [seen["changed"] for _, _, seen in jobs if "changed" in seen]
    assert changed in ([308, 4], [308, 4, 0])
    # Only what the result is read from is left.
    assert len(jobs[0][0].kept) == 1 + len(changed)


def test_a_loop_refuses_hops_by_bucket(spark):
    frame = spark.createDataFrame([(1, 2)], "src long, dst long")
    with pytest.raises(ValueError):
        paths.relax(frame, paths._from(frame, 1, 0), HOP_STEP, max_hops=3, bucket=2)


@pytest.fixture
def many_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_a_search_takes_the_tasks_its_edges_fill(spark, wide, jobs, many_partitions):
    """However wide the session is: every task tells the driver about itself, at every hop."""
    edges = random_intervals(random.Random(9), 40, 100)
    pairs = spark.createDataFrame([e[:2] for e in edges], "src long, dst long")
    before = spark.createDataFrame([(edges[0][0], 0), (edges[1][0], 3)], "id long, hops long")
    best, _ = relax(edges, {edges[0][0]: 2, edges[1][0]: 2}, lambda x, e: x + 1, 100)
    earlier = {edges[1][0]: 3, edges[0][0]: 0}
    found = paths.bfs_incremental(pairs, before, edges[0][0], 2)
    plans = [plan for _, plan, seen in jobs if "changed" in seen]
    widths = {int(n) for plan in plans for n in re.findall(r"hashpartitioning\(id#\d+L?, (\d+)\)", plan)}
    assert widths == {2}
    assert spark.conf.get("spark.sql.shuffle.partitions") == "64"
    assert rows(found) == sorted((v, min(x, earlier.get(v, x))) for v, x in best.items())


def test_a_search_that_fails_leaves_the_settings(spark, wide, many_partitions):
    edges = spark.createDataFrame([(k, k + 1) for k in range(100)], "src long, dst long")
    with pytest.raises(Exception):
        paths.relax(edges, paths._from(edges, 0, 0), "raise_error('no step') + value")
    assert spark.conf.get("spark.sql.shuffle.partitions") == "64"


@pytest.mark.parametrize("few", [1 << 17, 30])
def test_hops_broadcast_nothing(spark, monkeypatch, jobs, few):
    """A small table is not collected by the driver anew at every hop, in one partition or several."""
    monkeypatch.setattr(paths, "FEW_EDGES", few)
    frame = spark.createDataFrame([(0 if k % 20 == 0 else k, k + 1) for k in range(100)], "src long, dst long")
    assert rows(paths.bfs_hops(frame, 0)) == [(0, 0)] + [(k + 1, k % 20 + 1) for k in range(100)]
    plans = [plan for _, plan, seen in jobs if "changed" in seen]
    assert len(plans) >= 20 / paths.HOPS_A_JOB
    assert not [plan for plan in plans if "Broadcast" in plan]


def test_windows_are_searched_in_place(spark, monkeypatch, jobs, many_partitions):
    """Over several partitions: no wider than the window's edges, without broadcasts, and the same arrivals."""
    monkeypatch.setattr(paths, "FEW_EDGES", 30)
    edges = random_intervals(random.Random(6), 60, 400)
    frame = spark.createDataFrame(edges, "src long, dst long, start_tick long, end_tick long")
    seen = [(a, b, start, OPEN if end > 20 else end) for a, b, start, end in edges if 4 <= start < 18]
    best, _ = relax(seen, {1: 0}, clock, 100)
    assert rows(paths.window_clock_arrival(frame, 1, 4, 18)) == sorted(best.items())
    plans = [plan for _, plan, figures in jobs if "changed" in figures]
    widths = {int(n) for plan in plans for n in re.findall(r"hashpartitioning\(id#\d+L?, (\d+)\)", plan)}
    assert widths == {-(-len(seen) // 60)}
    assert not [plan for plan in plans if "Broadcast" in plan]
