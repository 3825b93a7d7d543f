import pytest

from verify import connect, session

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = session()
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def duck():
    return connect(SF)
