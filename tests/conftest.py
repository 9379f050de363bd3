import pytest

from recollect.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    yield s
