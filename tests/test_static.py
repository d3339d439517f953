import random

import pytest
from bruteforce import random_log, rows, run_in_order

from tidegraph.operators import static
from tidegraph.sources.commands import parse_commands


@pytest.fixture(scope="module")
def random_logs(spark):
    rng = random.Random(11)
    logs = [random_log(rng, 5, rng.randint(5, 40), range(100 * k, 100 * k + 6)) for k in range(120)]
    flat = [(t, pos, op, s, label, d) for log in logs for pos, (t, op, s, label, d) in enumerate(log)]
    frame = spark.createDataFrame(flat, "tick long, pos long, op string, src long, label string, dst long")
    return logs, frame.cache()


def test_bag(random_logs):
    logs, frame = random_logs
    expected = sorted(e for log in logs for e in run_in_order(log, True)[0])
    assert rows(static.fold_bag(frame).select("src", "dst", "label")) == expected


def test_set(random_logs):
    logs, frame = random_logs
    assert rows(static.fold_set(frame)) == sorted(e for log in logs for e in run_in_order(log, False)[0])


def test_vertices(random_logs):
    logs, frame = random_logs
    expected = sorted((v,) for log in logs for v in run_in_order(log, True)[1])
    assert rows(static.present_vertices(frame)) == expected
    assert rows(static.named_vertices(frame).select("id")) == expected


def test_lifetimes_give_every_snapshot(random_logs):
    logs, frame = random_logs
    lives = static.labelled_lifetimes(frame)
    for tick in range(1, 6):
        alive = lives.where(f"start_tick <= {tick} AND (end_tick IS NULL OR end_tick > {tick})")
        expected = sorted(e for log in logs for e in run_in_order([c for c in log if c[0] <= tick], True)[0])
        assert rows(alive.select("src", "dst", "label")) == expected


def test_names(spark):
    from tidegraph.sources.commands import parse_commands_short

    lines = ["addN 1 Jok", "addE 1 2 Hello", "addN 2 Jas", "addN 3 Gone", "delN 3 Gone", "addE 3 1 x", "addN 1 Joe"]
    log = parse_commands_short(
        spark.createDataFrame([(1, i, v) for i, v in enumerate(lines)], "tick long, pos long, value string")
    )
    assert rows(static.named_vertices(log, "John Doe")) == [(1, "Joe"), (2, "Jas"), (3, "John Doe")]


def _restore(spark, lines):
    log = parse_commands(
        spark.createDataFrame([(1, i, v) for i, v in enumerate(lines)], "tick long, pos long, value string")
    )
    stored = {1: [(8, 9, "old")], 2: [(1, 2, "a"), (1, 2, "a"), (2, 3, "b")]}
    # 2015-11-20 10:00:00 and 11:00:00 UTC.
    times = spark.createDataFrame([(1448013600000, 1), (1448017200000, 2)], "snapshot_ms long, tick long")
    base = lambda tick: spark.createDataFrame(stored[tick], "src long, dst long, label string")
    return rows(static.restore_then_fold(log, base, times))


def test_restore_replaces_the_graph(spark):
    lines = [
        "addEdge 5 x 6", "loadOld 2015-11-20 10:10:00", "addEdge 6 x 7",
        "loadOld 2015-11-20 10:40:00", "rmvEdge 2 b 3", "addEdge 3 c 4",
    ]
    assert _restore(spark, lines) == [(1, 2, "a"), (1, 2, "a"), (3, 4, "c")]


def test_restore_takes_the_earlier_snapshot_on_a_tie(spark):
    assert _restore(spark, ["loadOld 2015-11-20 10:30:00"]) == [(8, 9, "old")]


def test_no_restore(spark):
    assert _restore(spark, ["addEdge 5 x 6"]) == [(5, 6, "x")]
