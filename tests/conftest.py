import pytest

from cohortloom.session import build_session, ship


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", 4, 4)
    s.sparkContext.setLogLevel("OFF")
    ship(s)
    yield s
    s.stop()
