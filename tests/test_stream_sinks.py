import random

import pytest
from bruteforce import random_log, rows

from tidegraph.operators import activity, graph, static
from tidegraph.sources.commands import parse_commands
from tidegraph.sources.edge_lists import append_status
from tidegraph.streaming.append import EdgeAppends
from tidegraph.streaming.dossiers import DossierStream
from tidegraph.streaming.store import command_stream


def land(landing, number, lines):
    (landing / str(number)).mkdir(parents=True, exist_ok=True)
    (landing / str(number) / f"{len(list((landing / str(number)).iterdir()))}.txt").write_text("".join(f"{x}\n" for x in lines))


def test_appends_on_a_stream(spark, tmp_path):
    rng = random.Random(3)
    arrivals = [(t, rng.randrange(12), rng.randrange(12)) for t in (3, 4, 700, 701, 5000) for _ in range(6)]
    for portion in ((3, 4), (700,), (701, 5000)):
        for tick in portion:
            land(tmp_path / "in", tick - 1, [f"{s} x {d}" for t, s, d in arrivals if t == tick] + ["no edge"])
        # A new process each time: nothing is left but the store.
        stream = EdgeAppends(spark, str(tmp_path / "store"))
        stream.start(command_stream(spark, str(tmp_path / "in")), availableNow=True).awaitTermination()
    frame = spark.createDataFrame(arrivals, "tick long, src long, dst long")
    assert rows(stream.status()) == rows(append_status(frame))
    land(tmp_path / "in", 3, ["1 late 2"])
    with pytest.raises(Exception, match="new files after tick 5000"):
        stream.start(command_stream(spark, str(tmp_path / "in")), availableNow=True).awaitTermination()


def dossier(log):
    vertices = static.present_vertices(log).selectExpr("id", "concat('user', id) AS attr")
    triplets = graph.triplets(vertices, static.fold_set(log))
    return activity.vertex_dossier(vertices, triplets, activity.activity_log(log))


def batch_of(spark, lines):
    return spark.createDataFrame([(v, "f", 0) for v in lines], "value string, file string, block long").coalesce(1)


def test_dossiers_of_touched_vertices_only(spark, tmp_path):
    log = random_log(random.Random(6), 3, 60, range(9))
    lines = [f"{op} {s} {label} {d}" if op.endswith("Edge") else f"{op} {s}" for _, op, s, label, d in log]
    stream = DossierStream(spark, str(tmp_path / "store"), dossier)
    done = []
    for number, part in enumerate([lines[:40], [], ["bogus"], lines[40:50], ["addEdge 1 z 2"], ["rmvNode 1"]]):
        stream.apply(batch_of(spark, part), number)
        # Replayed, and by a process that knows nothing.
        stream = DossierStream(spark, str(tmp_path / "store"), dossier)
        stream.apply(batch_of(spark, part), number)
        done += part
        whole = spark.createDataFrame([(1, k, v) for k, v in enumerate(done)], "tick long, pos long, value string")
        assert rows(stream.dossiers()) == rows(dossier(parse_commands(whole)))
    touched = {b: {r[0] for r in rows(stream._read("touched", "id long").where(f"batch = {b}").select("id"))} for b in range(6)}
    assert touched[1] == touched[2] == set() and touched[4] == {1, 2}
    assert 1 in touched[5] and not (tmp_path / "store/log/batch=1").exists() and not (tmp_path / "store/lines/batch=2").exists()
