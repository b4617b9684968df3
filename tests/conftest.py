import pytest

from metricloom.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session("metricloom-tests", "8")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
