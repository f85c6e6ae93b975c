import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from relyard.session import build_session, new_location  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", 8, partitions=4)
    yield session
    session.stop()


@pytest.fixture()
def location(spark, request):
    return new_location(spark, f"test-{request.node.name[:20]}")
