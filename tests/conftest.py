import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from supplygraph.session import Scratch, local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, shuffle_partitions=4, app="tests")
    yield session
    session.stop()


@pytest.fixture
def scratch(spark):
    return Scratch(spark, "test")


@pytest.fixture
def rows():
    """Collects a DataFrame as a sorted list of tuples."""
    return lambda df, *cols: sorted(tuple(r) for r in (df.select(*cols) if cols else df).collect())
