import pytest

from busward.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4)
    yield session
    session.stop()
