"""Source mixing, nearest vectors, the pipeline and the registered SQL."""

import math
from collections import Counter

import duckdb
import numpy as np
import pytest
from edge_data import edge_rows
from pyspark.sql import functions as F

import corpus_pipeline
from check import TABLES, rows_of
from pubtrack.llm import mixing, nearest
from pubtrack.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


def water(sizes, weights, total, repeat=2):
    target, open_ = {}, set(sizes)
    while open_:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if repeat * sizes[s] <= level * weights[s]}
        if not full:
            return target | {s: level * weights[s] for s in open_}
        target |= {s: float(repeat * sizes[s]) for s in full}
        open_ -= full
    return target


def test_mix_edges(edges, none):
    got = mixing.mix_sources(edges).collect()
    assert len(got) == len(edge_rows()) and mixing.mix_sources(none).count() == 0
    sizes, longest = {}, {}
    for _, text, _, source in edge_rows():
        n = len((text or "").encode().split())
        sizes[source], longest[source] = sizes.get(source, 0) + n, max(longest.get(source, 0), n)
    order = sorted(s for s in sizes if s is not None) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target = water(sizes, weights, 1.5 * sum(sizes.values()))
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken == r.times * r.size and 0 <= r.times <= 2
    assert sum(r.taken for r in got) <= 1.5 * sum(sizes.values())
    assert {(r.doc_id, r.size): r.taken for r in mixing.mix_sources(edges.repartition(5)).collect()} == {(r.doc_id, r.size): r.taken for r in got}


def test_mixed_rows_are_the_decided_ones(spark, edges, clashing, none):
    docs = spark.createDataFrame([(1, "one two three", "a")] * 4 + [(2, "four five", "b"), (3, "six", None)], "doc_id long, text string, source string")
    for rows in (docs, edges, clashing):
        got = mixing.mixed_documents(rows)
        assert got.columns == rows.columns
        decided = {}
        for r in mixing.mix_sources(rows).collect():
            decided[(r.doc_id, r.source, r.size)] = decided.get((r.doc_id, r.source, r.size), 0) + r.times
        found = {}
        for r in got.collect():
            key = (r.doc_id, r.source, len((r.text or "").encode().split()))
            found[key] = found.get(key, 0) + 1
        assert found == {k: n for k, n in decided.items() if n}
    assert max(n for r, n in Counter((r.doc_id, r._turn) for r in mixing.mixed_documents(clashing).collect()).items()) <= 2
    assert mixing.mixed_documents(none).count() == 0 and mixing.mixed_documents(none).columns == none.columns


def test_sources_come_near_their_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = {}
    for r in mixing.mix_sources(docs).collect():
        taken, _, most = by.get(r.source, (0, 0, 0))
        by[r.source] = (taken + r.taken, r.target, max(most, r.size))
    assert all(abs(taken - target) <= 2 * most for taken, target, most in by.values())


def vectors(seed, n, dims):
    draw = np.random.default_rng(seed)
    return (draw.standard_normal((n, dims)) * draw.uniform(0.5, 2, (n, 1))).round(3)


def test_nearest_vectors(spark, monkeypatch):
    monkeypatch.setattr(nearest, "LIST_ROWS", 40)
    monkeypatch.setattr(nearest, "QUERY_ROWS", 3)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors(1, 600, 24))]
    rows += [(1000 + i, rows[3][1]) for i in range(80)]  # ties
    bad = [(2000, None), (2020, [0.0] * 24), (2040, [float("nan")] * 24), (2060, [None] * 24), (2080, [1.0, 2.0]), (2100, [math.inf] * 24), (None, rows[0][1])]
    table = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("list", F.lit(1))
    got = {}
    for r in nearest.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    queries = [i for i in range(len(ids)) if ids[i] % 20 == 0]
    assert set(got) == {int(ids[q]) for q in queries}
    hits = 0
    for q in queries:
        mine = sorted(got[ids[q]])
        assert [rank for rank, *_ in mine] == list(range(1, 21)) and all(i != ids[q] for _, i, _ in mine)
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        score = x @ x[q]
        assert all(s == pytest.approx(float(score[np.flatnonzero(ids == i)[0]]), rel=1e-12) for _, i, s in mine)
        score[q] = -np.inf
        hits += len({i for _, i, _ in mine} & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert hits >= 0.9 * 20 * len(queries)


def test_every_length_has_its_index_and_every_row_counts(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors(3, 60, 6))] + [(100 + i, [float(x) for x in v]) for i, v in enumerate(vectors(4, 30, 9))]
    rows += [(20, rows[20][1]), (7, rows[7][1]), (100, rows[-1][1])]  # identities of several rows
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in nearest.nearest(table, F.col("vec_id") % 20 == 0, 5, lists=1).collect())
    want = []
    for at, (i, v) in enumerate(rows):
        if i % 20 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w)), j) for other, (j, w) in enumerate(rows) if other != at and len(w) == len(v))[:5]
            want += [(i, rank + 1, j, -score) for rank, (score, j) in enumerate(scores)]
    assert [r[:3] for r in got] == [r[:3] for r in sorted(want)] and [r[3] for r in got] == pytest.approx([r[3] for r in sorted(want)])


def test_few_vectors_give_all_candidates(spark):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors(2, 7, 8))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert nearest.nearest(table, F.col("vec_id") == 0).count() == 6
    assert nearest.nearest(table.limit(1), F.col("vec_id") == 0).count() == 0
    assert nearest.nearest(table.limit(0), F.col("vec_id") == 0).columns == ["query_id", "rank", "vec_id", "score"]


def test_recall_on_the_given_table(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    got = {}
    for r in nearest.nearest(table, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        hits += len(got[ids[q]] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
        total += 20
    assert hits >= 0.9 * total


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES:
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    frame = QUERIES[name](spark, FOLDER)
    cursor = db.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(frame.columns)
    assert rows_of(frame.columns, [tuple(r) for r in frame.collect()]) == rows_of(columns, cursor.fetchall())


def test_all_queries_are_registered():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


def test_pipeline_stages(spark, small):
    """Every stage is held against what its own input implies."""
    from test_dedup import exact_rows, near_rows, plain

    docs, seen = small, []
    for _, stage in corpus_pipeline.STAGES:
        made = corpus_pipeline.shared_table(stage(spark, docs, FOLDER), "test")
        seen.append((docs, made))
        docs = made
    known, distinct, alone, mixed, tokens = [made for _, made in seen]
    assert all(made.columns == small.columns for _, made in seen[:-1])
    assert known.count() == small.count()  # all of these texts have a language
    want = sorted(k[0] for k in exact_rows(plain(known)) if k[3])
    assert sorted(i for i, _ in plain(distinct)) == want
    assert sorted(i for i, _ in plain(alone)) == sorted(k[0] for k in near_rows(plain(distinct)) if k[3])
    times = {r.doc_id: r.times for r in mixing.mix_sources(alone).collect()}
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: n for i, n in times.items() if n}
    assert tokens.count() == mixed.count() and tokens.where("n_tokens = 0").count() == 0
    assert corpus_pipeline.run(spark, FOLDER).count() == tokens.count()
