import pytest

from tidegraph.runtime import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(
        "tests", "4", **{"spark.sql.shuffle.partitions": "4", "spark.ui.showConsoleProgress": "false"}
    )
    yield session
    session.stop()


@pytest.fixture(scope="session")
def commands(spark):
    """Make a command log from ``(tick, "addEdge 1 a 2")`` pairs, in order."""
    from tidegraph.sources.commands import parse_commands

    def make(*lines):
        rows = [(tick, pos, line) for pos, (tick, line) in enumerate(lines)]
        return parse_commands(spark.createDataFrame(rows, "tick long, pos long, value string"))

    return make
