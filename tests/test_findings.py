"""Queries and operators at what reviews found in them."""

import unicodedata

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from check import TABLES, rows_of
from pubtrack.operators import index, inventory, search
from pubtrack.plans.stored import manifests
from pubtrack.session import cut

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", ["roster_members", "roster_violations"])
def test_chained_scans_of_a_roster_are_planned(spark, db, name):
    frame = entry_point.queries()[name](spark, FOLDER)
    cursor = db.execute(entry_point.oracle_sql()[name])
    columns = [c[0] for c in cursor.description]
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, cursor.fetchall())


def test_publish_loop_reads_a_table_of_many_files(spark, tmp_path):
    # Copies of a text lie in other files; the first files hold the largest ids.
    rows = spark.range(300).selectExpr("299 - id AS doc_id", "concat('t', (299 - id) % 40) AS text", "(299 - id) % 40 * 20 AS n_chars")
    rows.repartitionByRange(70, rows.doc_id.desc()).write.parquet(f"{tmp_path}/documents.parquet")
    got = entry_point.queries()["stream_publish_loop"](spark, str(tmp_path))
    sql = duckdb.connect().execute(entry_point.oracle_sql()["stream_publish_loop"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'"))
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(["doc_id", "status"], sql.fetchall())


def test_equal_ids_of_one_collection_merge_to_the_largest_value(table):
    first = table([("a", "xx", 1), ("b", "zz", 1)], "id string, lang string, seen int")
    for order in (["en", "fr", "de"], ["fr", "de", "en"], ["de", "en", "fr"]):
        second = table([("a", lang, n) for n, lang in enumerate(order)], "id string, lang string, seen int").coalesce(1)
        merged = inventory.merge_collections([first, second], "id", ["lang"], ["seen"])
        assert {tuple(r) for r in merged.collect()} == {("a", "fr", 2, 4, True), ("b", "zz", 1, 1, False)}


@pytest.mark.parametrize("broadcast_rows", [1000, 0])
def test_search_stores_no_pair_that_is_no_candidate(spark, table, monkeypatch, broadcast_rows):
    # All queries share every trigram of "common" with all records; only one record holds a whole query.
    monkeypatch.setattr(search, "SHORT_LIST", 7)
    monkeypatch.setattr(search, "BLOCK_RECORDS", 5)
    records = table([(n, f"common xword{n} word{n} {'z' * 70}end{n}", "k") for n in range(40)], "id long, t string, k string")
    asked = table([(n, f"common word{n} word{n} of") for n in range(40)] + [(99, f"{'z' * 65}end39")], "q long, text string")
    stored = []
    monkeypatch.setattr(search, "cut", lambda frame: stored.append(cut(frame)) or stored[-1])
    hits, outcomes = search.search_names(records.union(table([(-1, None, "k")], records.schema)), "id", "t", search.parse_queries(asked, "q", "text"), "q",
                                         [F.col("id")], broadcast_rows=broadcast_rows)
    holding = {n: [m for m in range(40) if f"word{n}" in f"common xword{m} word{m}"] for n in range(40)} | {99: [39]}
    assert {r["q"]: r["candidates"] for r in outcomes.collect()} == {n: len(v) for n, v in holding.items()}
    assert sum(frame.count() for frame in stored) == 41 + sum(map(len, holding.values()))
    assert {(r["q"], r["id"]) for r in hits.collect()} == {(99, 39)}  # no text holds "of"


def test_indexed_search_stores_records_and_no_pairs(table, spark, tmp_path, monkeypatch):
    root, stored = str(tmp_path / "index"), []
    index.extend_index(table([(n, f"common words here {n}") for n in range(60)], "id long, t string"), "id", "t", root, "a", buckets=4)
    parsed = search.parse_queries(table([(n, f"common words her {n}") for n in range(20)], "q long, text string"), "q", "text")
    monkeypatch.setattr(index, "cut", lambda frame: stored.append(cut(frame)) or stored[-1])
    got = index.indexed_search(spark, root, "id", "t", parsed, "q", [F.col("id")], page=100)
    assert {(r["q"], r["id"]) for r in got.collect()} == {(n, m) for n in range(20) for m in range(60) if str(n) in str(m)}
    assert max(frame.count() for frame in stored) == 60


def test_exact_fold_sends_only_other_scripts_to_python(spark, table, monkeypatch):
    from pyspark.sql import types as T

    from pubtrack.functions import text

    def exact(value):
        wide = unicodedata.normalize("NFKD", value).upper()
        return " ".join("".join(c for c in wide if not unicodedata.combining(c)).split())

    plain = ["", "  Mª  1º\tñ\r\n", "".join(map(chr, range(32, 127))), *[f"a{chr(c)} b" for c in range(0xA0, 0x250)], "\x1c a\x85b"]
    rows = table([(v,) for v in [*plain, "ﬁn ①", None]], "t string")
    assert {tuple(r) for r in rows.select("t", text.fold_exact(F.col("t"))).collect()} == {(v, exact(v)) for v in [*plain, "ﬁn ①"]} | {(None, None)}
    sent = spark.sparkContext.accumulator(0)

    @F.pandas_udf(T.StringType())
    def counted(values: pd.Series) -> pd.Series:
        sent.add(int(values.notna().sum()))
        return values

    monkeypatch.setattr(text, "_fold_exact", counted)
    table([("Árbol ñu",)] * 9 + [("①",)], "t string").select(text.fold_exact(F.col("t"))).collect()
    assert sent.value == 1


def test_rules_are_computed_once_for_their_violations(spark):
    plan = entry_point.queries()["box_violations"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    # Spark writes an inferred filter below the rules out in full; it would hold them a second time.
    assert not [line for line in plan.splitlines() if "Filter" in line and "lambdafunction" in line]


def test_manifests_are_stored_compressed_from_one_list_of_lines(spark):
    table = manifests(spark, FOLDER)
    files = table.inputFiles()
    assert files and all(name.endswith(".gz") for name in files)
    held = table.select(F.sum(F.size("documents")).alias("d"), F.sum(F.size("references") + F.size("observations")).alias("o")).first()
    assert held["d"] == held["o"] == spark.read.parquet(f"{FOLDER}/lineitem.parquet").count()


def test_a_text_is_folded_once_for_all_its_tokens(spark):
    plan = entry_point.queries()["token_multiset_match"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") == 1
