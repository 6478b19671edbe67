import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pubtrack.operators import scan  # noqa: E402
from pubtrack.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false",
        # Keep several slices even for tiny inputs, so that the carries between slices are exercised.
        "spark.sql.adaptive.coalescePartitions.enabled": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(autouse=True)
def sliced_scans(monkeypatch):
    """Test tables are tiny; ordered scans cut them into slices all the same."""
    monkeypatch.setattr(scan, "ONE_SLICE_BYTES", 0)


@pytest.fixture
def table(spark):
    def make(rows, schema):
        return spark.createDataFrame(rows, schema)

    return make
