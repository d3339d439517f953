import random

import pytest
from bruteforce import fold, random_log, rows
from pyspark.sql import functions as F

from tidegraph.operators.compact import compact_batches
from tidegraph.operators.intervals import as_commands, edge_intervals, graph_status, vertex_fold
from tidegraph.schema import OPEN

CASES = {
    "cancel in a tick": ([(1, "addEdge 1 a 2"), (1, "rmvEdge 1 a 2")], []),
    "unbroken re-add": ([(1, "addEdge 1 a 2"), (2, "rmvEdge 1 a 2"), (2, "addEdge 1 a 2")], [(1, 2, 1, OPEN)]),
    "node bounce": (
        [(1, "addEdge 1 a 2"), (2, "rmvNode 2"), (2, "addEdge 1 a 2")],
        [(1, 2, 1, 2), (1, 2, 2, OPEN)],
    ),
    "re-add is a no-op": ([(1, "addEdge 1 a 2"), (3, "addEdge 1 a 2")], [(1, 2, 1, OPEN)]),
    "reopen keeps history": (
        [(1, "addEdge 1 a 2"), (2, "rmvEdge 1 a 2"), (3, "addEdge 1 a 2")],
        [(1, 2, 1, 2), (1, 2, 3, OPEN)],
    ),
    "self-loop": ([(1, "addEdge 1 a 1"), (4, "rmvNode 1")], [(1, 1, 1, 4)]),
    "label does not matter": ([(1, "addEdge 1 a 2"), (2, "rmvEdge 1 b 2")], [(1, 2, 1, 2)]),
    "direction matters": ([(1, "addEdge 1 a 2"), (2, "rmvEdge 2 a 1")], [(1, 2, 1, OPEN)]),
    "node removal before anything": ([(1, "rmvNode 1"), (1, "addEdge 1 a 2")], [(1, 2, 1, OPEN)]),
    "empty": ([], []),
}


@pytest.mark.parametrize("name", CASES)
def test_hand_made(commands, name):
    log, expected = CASES[name]
    assert rows(edge_intervals(commands(*log))) == expected


def test_removals_first(commands):
    log = commands((1, "addEdge 1 a 2"), (1, "rmvEdge 1 a 2"))
    assert rows(edge_intervals(log, "remove_then_add")) == [(1, 2, 1, OPEN)]


def test_cancelled_edge_leaves_its_vertices(commands):
    log = commands((1, "addEdge 1 a 2"), (1, "rmvEdge 1 a 2"))
    assert rows(vertex_fold(log)) == [(1, 1, 1), (2, 1, 1)]


def test_implied_vertices_have_attr_zero(commands):
    log = commands((1, "addEdge 1 a 2"), (2, "addNode 2"), (3, "rmvNode 1"))
    assert rows(vertex_fold(log)) == [(1, 0, 1), (2, 1, 1)]


def test_status_counts_closed_intervals(commands):
    log = commands((1, "addEdge 1 a 2"), (2, "rmvEdge 1 a 2"), (3, "addEdge 1 a 2"), (3, "addNode 7"))
    status = graph_status(edge_intervals(log), vertex_fold(log))
    assert rows(status) == [(1, 1, 1, 0, 2), (2, 1, 0, 1, 2), (3, 2, 1, 1, 3)]


@pytest.fixture(scope="module")
def random_logs(spark):
    """120 independent logs side by side: log k lives on ids 100k to 100k + 5."""
    rng = random.Random(7)
    logs = [random_log(rng, 6, rng.randint(5, 40), range(100 * k, 100 * k + 6)) for k in range(120)]
    flat = [(t, pos, op, s, label, d) for log in logs for pos, (t, op, s, label, d) in enumerate(log)]
    frame = spark.createDataFrame(flat, "tick long, pos long, op string, src long, label string, dst long")
    return logs, frame.cache()


@pytest.mark.parametrize("mode", ["last_wins", "remove_then_add"])
def test_matches_fold_by_hand(random_logs, mode):
    logs, frame = random_logs
    expected = [fold(log, mode) for log in logs]
    assert rows(edge_intervals(frame, mode)) == sorted(e for edges, _ in expected for e in edges)
    assert rows(vertex_fold(frame, mode)) == sorted(v for _, vertices in expected for v in vertices)


def test_compaction_keeps_the_fold_and_is_stable(random_logs):
    _, frame = random_logs
    compacted = compact_batches(frame)
    assert rows(edge_intervals(compacted)) == rows(edge_intervals(frame))
    assert rows(compact_batches(compacted).na.fill(-1)) == rows(compacted.na.fill(-1))


def test_fold_goes_on_from_open_edges(random_logs):
    _, frame = random_logs
    early = edge_intervals(frame.where("tick <= 3"))
    closed = early.where(F.col("end_tick") < OPEN)
    log = as_commands(early.where(F.col("end_tick") == OPEN)).unionByName(
        frame.where("tick > 3").select("tick", "pos", "op", "src", "dst")
    )
    assert rows(closed.unionByName(edge_intervals(log))) == rows(edge_intervals(frame))
