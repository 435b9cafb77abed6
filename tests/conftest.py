import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from medloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = local_session(
        "4", **{"spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g"}
    )
    yield session


@pytest.fixture
def show():
    """Rows of a frame as plain dicts."""
    return lambda df: [r.asDict(recursive=True) for r in df.collect()]
