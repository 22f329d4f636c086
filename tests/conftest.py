import pytest

from sedimenta.session import local_session


@pytest.fixture(scope="session")
def spark():
    s = local_session(2, 8, "tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()
