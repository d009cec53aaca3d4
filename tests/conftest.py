import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from tallyspark.session import local_session

    return local_session("tests", 4, 2)


@pytest.fixture
def sliced(monkeypatch):
    """Force many value slices on tiny data, so the distributed paths are exercised."""
    from tallyspark.operators import ordered

    monkeypatch.setattr(ordered, "ROWS_PER_SLICE", 7)
