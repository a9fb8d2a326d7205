import pytest

from weftline.session import build_session


@pytest.fixture(scope="session")
def spark():
    s = build_session("tests", shuffle_partitions=2)
    yield s
    s.stop()
