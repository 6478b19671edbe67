import os
import sys

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from edge_data import SCHEMA, edge_rows  # noqa: E402


@pytest.fixture(scope="session")
def edges(spark):
    rows = spark.createDataFrame(edge_rows(), SCHEMA)
    # Columns that operators use as names of their own must not disturb them.
    for name in ("row", "size", "key", "sha", "node", "cid", "hash", "at", "id", "places", "seeds", "blob", "spans", "kept", "tokens", "part", "keep_id", "target"):
        rows = rows.withColumn(name, F.lit("clash"))
    return rows


@pytest.fixture(scope="session")
def clashing(edges):
    """The edge rows and more repeats, with the names that stages once used for themselves."""
    names = ("_kept_id", "_kept_sha", "_sha_of_text", "_number_of_row", "_mix_id", "_times", "_own_size", "_turn", "record", "doc", "tag", "place", "times", "rows", "total", "component")
    twice = edges.unionByName(edges.where("doc_id IN (5, 9, 12) OR doc_id IS NULL"))
    return twice.withColumns({name: F.monotonically_increasing_id().cast("string") if name == "_turn" else F.lit("clash") for name in names})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
