import random

import pytest
from bruteforce import OPEN, rows

from tidegraph.operators import timetravel
from tidegraph.sources import interval_store as store


@pytest.fixture(scope="module")
def history(spark):
    rng = random.Random(4)
    edges = {(k % 9, k, s, rng.choice([OPEN, s + rng.randint(1, 12)])) for k in range(200) for s in [rng.randint(1, 30)]}
    return spark.createDataFrame(sorted(edges), "src long, dst long, start_tick long, end_tick long").persist()


@pytest.fixture(scope="module")
def path(history, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("intervals") / "store")
    store.write_intervals(history, path)
    return path


@pytest.mark.parametrize("tick", [0, 1, 5, 6, 12, 30, 60])
def test_questions_about_a_tick(spark, history, path, tick):
    assert rows(store.intervals_as_of(spark, path, tick)) == rows(timetravel.graph_as_of(history, tick))
    assert rows(store.intervals_at(spark, path, tick)) == rows(timetravel.checkpoint_at(history, tick))
    assert rows(store.window_of(spark, path, tick, tick + 7)) == rows(timetravel.window_edges(history, tick, tick + 7))


def test_directories_are_pruned_by_both_ends(spark, path):
    plan = store.intervals_as_of(spark, path, 12)._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan" in line)
    filters = scan.split("PartitionFilters: [")[1].split("]")[0]
    assert "started" in filters and "ended" in filters and "open" in filters
    assert "start_tick" in scan.split("PushedFilters: [")[1]


def test_storage_is_linear_and_deltas_make_up_a_checkpoint(spark, history, path):
    assert store.read_intervals(spark, path).count() == history.count()
    deltas = store.checkpoint_deltas(spark, path)
    assert deltas.count() <= 2 * history.count()
    for tick in (5, 20):
        known = {}
        for _, change, *edge in sorted(rows(deltas.where(f"tick <= {tick}")), key=lambda r: (r[0], r[1] == "end")):
            known[tuple(edge[:3])] = edge[3]
        assert sorted((*k, e) for k, e in known.items()) == rows(store.intervals_at(spark, path, tick))
    assert rows(store.checkpoint_deltas(spark, path, 10)) == rows(deltas.where("tick = 10"))


def test_the_store_goes_on_without_touching_closed_intervals(spark, history, tmp_path):
    path = str(tmp_path / "store")
    store.write_intervals(timetravel.checkpoint_at(history, 15), path)
    closed = {f for f in spark.read.parquet(path).inputFiles() if "open=false" in f}
    store.replace_open(history.where("end_tick > 15"), path, since=15)
    assert rows(store.read_intervals(spark, path)) == rows(history)
    assert closed and closed <= set(spark.read.parquet(path).inputFiles())
