import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lineweave.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session("tests", cpus="8", **{"spark.driver.memory": "6g"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def files(spark):
    """``(path, text)`` pairs as binary files, the way a source delivers them."""
    def build(*pairs):
        rows = [(path, len(data), None, bytearray(data)) for path, data in (
            (p, t if isinstance(t, bytes) else t.encode()) for p, t in pairs)]
        return spark.createDataFrame(rows, "path string, size bigint, modified timestamp, content binary")
    return build
