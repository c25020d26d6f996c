import pytest

from cairn.session import session


@pytest.fixture(scope="session")
def spark():
    s = session("tests", cores="4", partitions=4, memory="4g")
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
