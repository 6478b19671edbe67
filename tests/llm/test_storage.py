"""What stored intermediate tables leave behind."""

import time

from pyspark.sql import functions as F

from pubtrack.llm import near
from pubtrack.llm.common import SHUFFLE_CLEANUP, perhaps, shared_table
from pubtrack.llm.exact import keep_distinct
from pubtrack.llm.near import keep_representatives


def shuffle_files(spark):
    held = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {held.apply(i).getName() for i in range(held.size()) if held.apply(i).getName().startswith("shuffle_")}


def test_shared_table_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLE_CLEANUP, None)
    table = shared_table(spark.range(10_000).repartition(3, "id"), "some")
    until = time.time() + 20
    while (left := shuffle_files(spark) - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert table.count() == 10_000 and table.distinct().count() == 10_000
    assert spark.conf.get(SHUFFLE_CLEANUP, None) == setting


def shuffles_after_join(spark, frame):
    """Is a window over the joined rows dealt out a second time?"""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = frame()._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = plan[:plan.index("SortMergeJoin")]
    return "Window" not in above or "Exchange" in above


def test_exact_dedup_shuffles_the_documents_once(spark, small):
    assert not shuffles_after_join(spark, lambda: keep_distinct(small))


def test_near_dedup_shuffles_the_documents_once(spark, small):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = keep_representatives(small)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    above = plan[:plan.index("SortMergeJoin")]
    assert "Window" in above and "Exchange" not in above


def test_perhaps_keeps_all_wanted_rows_and_few_others(spark):
    rows = spark.range(-50_000, 50_000).select(F.col("id").alias("key"), F.lit("text").alias("text"))
    for wanted in (spark.range(-3000, 3000).select(F.col("id").alias("key")), spark.range(0)):
        wanted = shared_table(wanted.toDF("key"), "wanted")
        found = perhaps(rows, "key", wanted, wanted.count())
        assert found.columns == rows.columns
        assert found.join(wanted, "key").count() == wanted.count()
        assert found.count() - wanted.count() < 0.15 * rows.count()


def test_near_dedup_shuffles_only_texts_of_its_pairs(spark, monkeypatch):
    texts = shared_table(spark.range(20_000).select(F.col("id").alias("cid"), F.concat_ws(" ", *[F.lit(w) for w in "abcdef"], (F.col("id") / 2).cast("int")).alias("text")), "texts")
    left = []

    def counted(*given):
        found = perhaps(*given)
        left.append(found.count())
        return found

    monkeypatch.setattr(near, "perhaps", counted)
    monkeypatch.setattr(near, "FILTERED_BYTES", 0)
    pairs = spark.createDataFrame([(1, 0), (5, 4), (6, 4)], "a long, b long")
    assert {tuple(r) for r in near.linked(pairs, texts, 5, 75).collect()} == {(1, 0), (5, 4)}
    assert len(left) == 2 and max(left) < 200


def test_near_dedup_of_filtered_texts_gives_the_same(spark, small, monkeypatch):
    expected = sorted(map(tuple, near.near_components(small).collect()))
    monkeypatch.setattr(near, "FILTERED_BYTES", 0)
    assert sorted(map(tuple, near.near_components(small).collect())) == expected
