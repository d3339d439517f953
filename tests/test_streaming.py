import random

import pytest
from bruteforce import fold, random_log, rows, run_in_order

from tidegraph.sources.commands import parse_commands_short
from tidegraph.streaming.fold import StreamingFold
from tidegraph.streaming.sequential import SequentialFold
from tidegraph.streaming.store import command_stream


def text(log):
    for _, op, src, label, dst in log:
        yield f"{op} {src} {label} {dst}" if op.endswith("Edge") else f"{op} {src}"


def land(folder, tick, log, files=1):
    """Write one batch as ``files`` files whose names sort in log order."""
    folder.mkdir(exist_ok=True)
    commands = list(text(log)) + ["bogus"]
    size = -(-len(commands) // files)
    for i in range(files):
        part = commands[i * size : (i + 1) * size]
        (folder / f"{tick:03d}-{i}.txt").write_text("".join(line + "\n" for line in part))


def run(spark, store, landing, mode="last_wins", every=2):
    """A new process each time: nothing is left but the store."""
    stream = StreamingFold(spark, str(store), mode, every=every)
    stream.start(command_stream(spark, str(landing)), availableNow=True).awaitTermination()
    return stream


@pytest.mark.parametrize("mode", ["last_wins", "remove_then_add"])
def test_matches_the_fold_by_hand_after_every_batch(spark, tmp_path, mode):
    log = random_log(random.Random(3), 3, 80, range(8))
    landing, store = tmp_path / "in", tmp_path / "store"
    for tick in range(1, 4):
        land(landing, tick, [c for c in log if c[0] == tick], files=3)
        stream = run(spark, store, landing, mode)
        edges, vertices = fold([c for c in log if c[0] <= tick], mode)
        assert stream.tick() == tick
        assert rows(stream.edges()) == edges
    assert rows(stream.vertices()) == vertices
    last = rows(stream.status())[-1]
    assert last[1] == len(edges) and last[4] == len(vertices)


def test_a_batch_without_lines_is_no_tick(spark, tmp_path):
    landing, store = tmp_path / "in", tmp_path / "store"
    land(landing, 1, [(1, "addEdge", 1, "a", 2)])
    run(spark, store, landing)
    (landing / "002-empty.txt").write_text("")
    run(spark, store, landing)
    land(landing, 3, [(2, "rmvNode", 2, "a", 0)])
    stream = run(spark, store, landing)
    assert stream.tick() == 2
    assert rows(stream.edges()) == [(1, 2, 1, 2)]


def test_replaying_a_batch_changes_nothing(spark, tmp_path):
    log = random_log(random.Random(5), 3, 80, range(8))
    stream = StreamingFold(spark, str(tmp_path / "store"), every=2)

    def batch(tick):
        return batch_of(spark, list(text([c for c in log if c[0] == tick])))

    for tick in range(1, 4):
        stream.apply(batch(tick), tick + 10)
        # The same batch again, from a process that knows nothing.
        stream = StreamingFold(spark, str(tmp_path / "store"), every=2)
        stream.apply(batch(tick), tick + 10)
    assert stream.tick() == 3
    assert rows(stream.edges()) == fold(log, "last_wins")[0]


def test_other_dialect(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    (landing / "a.txt").write_text("addE 1 2 x\nnonsense\naddN 3 Jok\n")
    stream = StreamingFold(spark, str(tmp_path / "store"), parse=parse_commands_short)
    stream.start(command_stream(spark, str(landing)), availableNow=True).awaitTermination()
    assert [r[:3] for r in rows(stream.edges())] == [(1, 2, 1)]
    assert rows(stream.vertices()) == [(1, 0, 1), (2, 0, 1), (3, 1, 1)]


class Clock:
    """A day passes between batches."""

    def __init__(self):
        self.now = 1448013600  # 2015-11-20 10:00:00 UTC

    def __call__(self):
        self.now += 86400
        return self.now


def batch_of(spark, lines):
    return spark.createDataFrame([(v, "f", 0) for v in lines], "value string, file string, block long").coalesce(1)


@pytest.mark.parametrize("keep", ["bag", "set"])
def test_sequential_fold_batch_by_batch(spark, tmp_path, keep):
    log = random_log(random.Random(8), 3, 90, range(6))
    stream = SequentialFold(spark, str(tmp_path / "store"), keep, every=2)
    for tick in range(1, 4):
        lines = list(text([c for c in log if c[0] == tick]))
        stream.apply(batch_of(spark, lines), tick)
        stream = SequentialFold(spark, str(tmp_path / "store"), keep, every=2)
        if tick == 2:
            stream.apply(batch_of(spark, lines), tick)
        edges, vertices = run_in_order([c for c in log if c[0] <= tick], keep == "bag")
        assert rows(stream.edges()) == edges
        assert rows(stream.vertices().select("id")) == [(v,) for v in vertices]


def test_sequential_fold_restores_a_snapshot(spark, tmp_path):
    stream = SequentialFold(spark, str(tmp_path / "store"), every=1, clock=Clock())
    stream.apply(batch_of(spark, ["addEdge 1 a 2"]), 1)  # 2015-11-21
    stream.apply(batch_of(spark, ["addEdge 2 b 3"]), 2)  # 2015-11-22
    stream.apply(batch_of(spark, ["rmvNode 1", "addEdge 3 c 4"]), 3)  # 2015-11-23
    assert rows(stream.edges()) == [(2, 3, "b"), (3, 4, "c")]
    stream.apply(batch_of(spark, ["addEdge 7 x 8", "loadOld 2015-11-21 11:00:00", "addEdge 5 d 6"]), 4)
    assert rows(stream.edges()) == [(1, 2, "a"), (5, 6, "d")]
    assert rows(stream.vertices().select("id")) == [(1,), (2,), (5,), (6,)]
    stream.apply(batch_of(spark, ["rmvEdge 1 a 2"]), 5)
    assert rows(stream.edges()) == [(5, 6, "d")]


def test_names_last_over_batches(spark, tmp_path):
    stream = SequentialFold(
        spark, str(tmp_path / "store"), "set", "John Doe", every=2, parse=parse_commands_short
    )
    stream.apply(batch_of(spark, ["addN 1 Jok", "addE 1 2 x", "addN 3 Gone"]), 1)
    stream.apply(batch_of(spark, ["addE 3 1 y", "delN 3 Gone"]), 2)
    stream.apply(batch_of(spark, ["addE 1 3 z", "addN 2 Jas"]), 3)
    assert rows(stream.vertices()) == [(1, "Jok"), (2, "Jas"), (3, "John Doe")]


@pytest.mark.parametrize("kind", [StreamingFold, SequentialFold])
def test_readers_see_committed_ticks_only(spark, tmp_path, kind):
    stream = kind(spark, str(tmp_path / "store"), every=10)
    stream.apply(batch_of(spark, ["addEdge 1 a 2"]), 1)
    before = rows(stream.edges()), rows(stream.vertices())
    write = stream.overwrite

    def fails_at_the_marker(df, name, *partitions):
        if name.startswith("ticks/"):
            raise RuntimeError("lost")
        write(df, name, *partitions)

    stream.overwrite = fails_at_the_marker
    with pytest.raises(RuntimeError):
        stream.apply(batch_of(spark, ["addEdge 3 b 4"]), 2)
    reader = kind(spark, str(tmp_path / "store"), every=10)
    assert (rows(reader.edges()), rows(reader.vertices())) == before
    reader.apply(batch_of(spark, ["addEdge 3 b 4"]), 2)
    assert len(rows(reader.edges())) == 2


def test_restore_without_a_snapshot_empties_the_graph_in_both_forms(spark, tmp_path, commands):
    from tidegraph.operators.static import restore_then_fold

    ticks = [["addEdge 1 a 2"], ["addEdge 3 b 4", "loadOld 2015-11-21 11:00:00", "addEdge 5 d 6"], ["addEdge 7 e 8"]]
    stream = SequentialFold(spark, str(tmp_path / "store"), every=10)
    for k, lines in enumerate(ticks, 1):
        stream.apply(batch_of(spark, lines), k)
    log = commands(*[(k, line) for k, lines in enumerate(ticks, 1) for line in lines])
    none = spark.createDataFrame([], "snapshot_ms long, tick long")
    expected = [(5, 6, "d"), (7, 8, "e")]
    assert rows(stream.edges()) == expected
    assert rows(restore_then_fold(log, None, none)) == expected


def test_numbered_directories_are_ticks_however_they_arrive(spark, tmp_path):
    log = random_log(random.Random(4), 7, 120, range(8))
    landing = tmp_path / "in"
    landing.mkdir()

    def arrive(*ticks):
        for tick in ticks:
            folder = landing / str(tick - 1)
            folder.mkdir()
            (folder / "a.txt").write_text("".join(line + "\n" for line in text([c for c in log if c[0] == tick])))

    def resume():
        stream = StreamingFold(spark, str(tmp_path / "store"), every=3, numbered=True)
        stream.start(command_stream(spark, str(landing)), availableNow=True).awaitTermination()
        return stream

    arrive(1, 2, 3, 4)
    assert rows(resume().edges()) == fold([c for c in log if c[0] <= 4], "last_wins")[0]
    arrive(5, 6, 7)
    stream = resume()
    assert stream.tick() == 7
    assert rows(stream.edges()) == fold(log, "last_wins")[0]
    batch = spark.createDataFrame([("addEdge 1 a 2", 2, "f", 0)], "value string, batch long, file string, block long")
    with pytest.raises(ValueError):
        stream.apply(batch, 99)


@pytest.mark.parametrize("kind", [StreamingFold, SequentialFold])
def test_retention_bounds_the_store(spark, tmp_path, kind):
    log = random_log(random.Random(6), 12, 120, range(8))
    stream = kind(spark, str(tmp_path / "store"), every=2, retain=1)
    for tick in range(1, 13):
        stream.apply(batch_of(spark, list(text([c for c in log if c[0] == tick]))), tick)
        # A new process goes on, and may repeat the last batch.
        stream = kind(spark, str(tmp_path / "store"), every=2, retain=1)
        if tick in (4, 7):
            stream.apply(batch_of(spark, list(text([c for c in log if c[0] == tick]))), tick)
    assert len(list((tmp_path / "store" / "log").glob("tick=*"))) <= 4
    if kind is StreamingFold:
        assert rows(stream.edges()) == fold(log, "last_wins")[0]
        assert rows(stream.vertices()) == fold(log, "last_wins")[1]
        # Every version that is kept goes back to a full one.
        kept = sorted(int(f.name[8:]) for f in (tmp_path / "store" / "vertices").glob("version=*") if f.name != "version=-1")
        full = sorted(int(f.name[8:]) for f in (tmp_path / "store" / "open").glob("version=*") if f.name != "version=-1")
        assert kept[0] == full[0] and 10 in kept and 12 in kept and len(kept) < 6
    else:
        assert rows(stream.edges()) == run_in_order(log, True)[0]


def test_marks_take_a_bounded_number_of_folders(spark, tmp_path):
    stream = SequentialFold(spark, str(tmp_path / "store"), every=2, retain=1)
    counts = []
    for tick in range(1, 15):
        stream.apply(batch_of(spark, [f"addEdge {tick} a {tick + 1}"]), tick)
        counts.append(len(list((tmp_path / "store" / "ticks").glob("batch=*"))))
    assert max(counts[6:]) <= 6 and max(counts[10:]) <= max(counts[6:10])
    # All snapshots can still be asked for, by a process that knows nothing.
    stream = SequentialFold(spark, str(tmp_path / "store"), every=2, retain=1)
    assert [r[0] for r in rows(stream.ticks().where("tick = version").select("tick"))] == list(range(2, 15, 2))
    stream.apply(batch_of(spark, ["addEdge 1 a 2"]), 14)  # a replay that lost its commit
    assert stream.tick() == 14


def test_numbers_far_apart_cost_no_more_than_those_there_are(spark, tmp_path):
    log = [(t, "addEdge", k, "a", k + 1) for k, t in enumerate([1, 5, 1_700_000_000_001, 1_700_000_000_002, 1_700_000_900_001])]
    for start in (0, 3):
        for tick, *rest in log[start : start + 3]:
            (tmp_path / "in" / str(tick - 1)).mkdir(parents=True, exist_ok=True)
            (tmp_path / "in" / str(tick - 1) / "a.txt").write_text("".join(f"{x}\n" for x in text([(tick, *rest)])))
        stream = StreamingFold(spark, str(tmp_path / "store"), every=2, numbered=True, retain=1)
        stream.start(command_stream(spark, str(tmp_path / "in")), availableNow=True).awaitTermination()
    assert rows(stream.edges()) == fold(log, "last_wins")[0]
    assert len(list((tmp_path / "store" / "closed").glob("version=*"))) == 3


def test_in_order_over_numbered_directories_with_restores(spark, tmp_path):
    batches = [["addEdge 1 a 2"], ["addEdge 2 b 3"], ["rmvNode 1", "addEdge 3 c 4"],
               ["addEdge 7 x 8", "loadOld 2015-11-21 11:00:00", "addEdge 5 d 6"], ["rmvEdge 1 a 2"]]
    for number, lines in zip((0, 2, 3, 9, 40), batches, strict=True):
        (tmp_path / "in" / str(number)).mkdir(parents=True)
        (tmp_path / "in" / str(number) / "a.txt").write_text("".join(f"{x}\n" for x in lines))
    stream = SequentialFold(spark, str(tmp_path / "store"), every=1, clock=Clock(), numbered=True)
    stream.start(command_stream(spark, str(tmp_path / "in")), availableNow=True).awaitTermination()
    assert stream.tick() == 41
    assert rows(stream.edges()) == [(5, 6, "d")]
    assert rows(stream.vertices().select("id")) == [(1,), (2,), (5,), (6,)]


def test_bytes_of_a_version_follow_its_changes(spark, tmp_path):
    many = [f"addEdge {k} a {k + 1}" for k in range(3000)]
    batches = [many, ["addEdge 1 a 9"], ["rmvEdge 5 a 6", "addNode 4"], ["rmvNode 7"]]
    stream = StreamingFold(spark, str(tmp_path / "store"), every=1)
    for tick, lines in enumerate(batches, 1):
        stream.apply(batch_of(spark, lines), tick)
    size = {
        tick: sum(f.stat().st_size for name in ("open", "opened", "closed", "vertices")
                  for f in (tmp_path / "store" / name / f"version={tick}").glob("*.parquet"))
        for tick in range(1, 5)
    }
    assert all(size[tick] < size[1] / 4 for tick in (2, 3, 4))
    log = [(t, op, int(s), "a", int(rest[-1]) if rest else 0) for t, b in enumerate(batches, 1) for op, s, *rest in (x.split() for x in b)]
    assert rows(stream.edges()) == fold(log, "last_wins")[0]
    assert rows(stream.vertices()) == fold(log, "last_wins")[1]
