import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SF = os.environ.get("WATCHPOST_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from watchpost.session import local_session
    s = local_session(4, "watchpost-tests")
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture
def hot(monkeypatch):
    """Treat every key above 40 rows as hot, so chunked plans are exercised."""
    from watchpost.operators import ordered
    monkeypatch.setattr(ordered, "TARGET_ROWS", 40)
