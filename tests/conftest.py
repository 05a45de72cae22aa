import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from tracewright import get_spark  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = get_spark(
        "tests", master="local[8]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false",
        spark__driver__memory="6g")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture
def make_log(spark):
    """A log from `case activity start complete` tuples; the order of the tuples breaks ties."""

    def build(*rows):
        return spark.createDataFrame(
            [(str(case), activity, start, complete, i) for i, (case, activity, start, complete) in enumerate(rows)],
            "trace string, activity string, timestamp long, timestampf long, event_seq long")

    return build


@pytest.fixture
def make_cases(make_log):
    """A log from one string of activities per case, such as `A B C`; events last one second."""

    def build(*cases):
        return make_log(*[
            (f"c{i:03}", activity, 10_000 * at, 10_000 * at + 1000)
            for i, case in enumerate(cases) for at, activity in enumerate(case.split(), start=1)])

    return build
