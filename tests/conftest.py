import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tracelode.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("4", "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def chunked(spark):
    """Forces the paths meant for groups too large for one task."""
    names = {"spark.tracelode.maxGroupRows": "20", "spark.tracelode.chunkRows": "8"}
    for name, value in names.items():
        spark.conf.set(name, value)
    yield spark
    for name in names:
        spark.conf.unset(name)
