import pytest

from marlstone.session import session


@pytest.fixture(scope="session")
def spark():
    return session("local[4]", partitions=4)
