import pytest

from tallyroom.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("local[4]", shuffle_partitions=4)
    yield s
    s.stop()
