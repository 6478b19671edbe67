import random

from pyspark.sql import functions as F

from pubtrack.operators import index, search
from pubtrack.sources import sinks

NAMES = ["martinez", "carlos", "lopez", "ana", "garcia", "alvaro", "eva", "ñandú 漢字"]


def corpus_rows(n, seed=5):
    rng = random.Random(seed)
    return [(i * 3, " ".join(rng.choice(NAMES) for _ in range(rng.randrange(1, 5))), i % 4) for i in range(n)]


QUERIES = [(1, "tinez carlos"), (2, "martinez martinez"), (3, "alv"), (4, "zzzzzz"), (5, "ana eva ana"), (6, "garcia"), (7, "lopez an"), (8, "ab"), (9, "garcia lopez carlos")]


def pages(frame):
    return sorted(map(tuple, frame.select("q", "id", "position").collect()))


def test_indexed_search_equals_batch_search(table, spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "PART_RECORDS", 50)
    rows, root = corpus_rows(300), str(tmp_path / "index")
    frame = table(rows, "id long, t string, k int")
    parsed = search.parse_queries(table(QUERIES, "q long, text string"), "q", "text")
    # Records arrive in three generations, one of them twice, the last one with nothing new.
    for generation, some in (("a", frame.where("id < 300")), ("b", frame.where("id < 600")), ("b", frame.where("id < 600")), ("c", frame), ("d", frame)):
        index.extend_index(some, "id", "t", root, generation, buckets=8)
    assert {r[0] for r in spark.read.parquet(f"{root}/texts").select("generation").distinct().collect()} == {"a", "b", "c"}
    assert spark.read.parquet(f"{root}/texts").count() == 300
    for skip in (0, 10):
        want, _ = search.search_names(frame, "id", "t", parsed, "q", [F.col("k"), F.col("id")], page=10, skip=skip)
        got = index.indexed_search(spark, root, "id", "t", parsed, "q", [F.col("k"), F.col("id")], page=10, skip=skip)
        assert pages(got) == pages(want) and got.count() > 20


def test_only_touched_buckets_are_read(table, spark, tmp_path):
    root = str(tmp_path / "index")
    rows = corpus_rows(200) + [(9000 + i, f"unusual{i}", 0) for i in range(3)]
    index.extend_index(table(rows, "id long, t string, k int"), "id", "t", root, "a", buckets=64)
    parsed = search.parse_queries(table([(1, "unusual2")], "q long, text string"), "q", "text")
    got = index.indexed_search(spark, root, "id", "t", parsed, "q", [F.col("id")])
    assert [r["id"] for r in got.collect()] == [9002]
    grams = parsed.select(F.explode("grams").alias("gram"))
    lists = index.opened(spark, f"{root}/lists", grams, "gram", 64)

    read = {f.rsplit("/", 2)[1] for f in lists.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
    assert len(read) <= grams.count() < 64
    found = index.indexed_candidates(spark, root, parsed, "q")
    assert [tuple(r) for r in found.collect()] == [(1, 9002)] or found.count() <= 3


def test_archive_reads_only_touched_prefixes(spark, tmp_path):
    path = str(tmp_path / "archive")
    contents = lambda ids: spark.createDataFrame([(i,) for i in ids], "doc_id long").withColumn("sha256", F.sha2(F.concat(F.lit("text"), (F.col("doc_id") % 500).cast("string")), 256))
    sinks.append_by_prefix(contents(range(400)), path, "sha256", "doc_id")
    sinks.append_by_prefix(contents([700, 7, 450, 950]), path, "sha256", "doc_id")  # 200 and 7 are known, 450 and 950 are equal
    assert sorted(r[0] for r in spark.read.parquet(path).select("doc_id").collect()) == [*range(400), 450]
    few = sinks.stored_like(contents([3, 4]), path, "sha256")
    plan = few._jdf.queryExecution().toString()
    assert "PartitionFilters: [prefix" in plan and "PushedFilters: [In(sha256" in plan
    assert sorted(r[0] for r in few.select("doc_id").collect()) == [3, 4]
    many = sinks.stored_like(contents([3, 4]), path, "sha256", few=0)
    assert {r[0] for r in many.select("prefix").distinct().collect()} == {r[0] for r in contents([3, 4]).select(sinks.prefix_of(F.col("sha256"))).collect()}
