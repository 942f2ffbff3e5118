import pytest

from tidewrack.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", master="local[4]", partitions=4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
