import duckdb
import pytest

import __spark_entry__ as entry_point
from check import TABLES, rows_of

FOLDER = "/root/testdata/sf0.001"
SAMPLE = ["snapshot_diff", "compatible_publications", "semantic_digest", "ordinal_rank", "amended_list", "row_rule_violations", "page_links",
          "disappeared_documents", "manifest_reconciliation", "family_coverage", "content_revisions", "health_assessment", "work_queue",
          "failure_backoff", "batch_search_outcomes", "rarest_gram", "line_heading_context", "page_sections", "activation_report",
          "generation_blocks", "keyset_batch", "pruned_backoff", "record_violations", "ordered_facets", "verified_originals", "delayed_budget", "write_ledger", "throttle_batch", "daily_budget", "change_probe", "write_usage", "stream_throttle"]


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, db, name):
    frame = entry_point.queries()[name](spark, FOLDER)
    cursor = db.execute(entry_point.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, cursor.fetchall())


def test_contract(spark):
    queries, oracles = entry_point.queries(), entry_point.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 150
    assert entry_point.entry(spark).count() > 0
