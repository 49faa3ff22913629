import pytest

from lexmill import session


@pytest.fixture(scope="session")
def spark():
    return session.build("local[4]", 4)
