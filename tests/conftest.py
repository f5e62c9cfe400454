import pytest

from plumbline.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, app="plumbline-tests", **{"spark.sql.shuffle.partitions": "4"})
    yield session
    session.stop()
