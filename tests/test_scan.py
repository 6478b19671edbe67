import random

import pytest
from pyspark.sql import functions as F

from pubtrack.operators import scan
from pubtrack.operators.scan import (following, highest, known_before, last_known, next_known, ordered_scan, previous, rank, slice_rows,
                                     top_per_key, total)


def rows_with_hot_key(seed=3, n=400):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
        rows.append((i, key, rng.randrange(1000), rng.choice([None, rng.randrange(50)])))
    return rows


@pytest.mark.parametrize("one_slice", [0, 1 << 30])
def test_scan_equals_brute_force_over_slices(spark, table, monkeypatch, one_slice):
    monkeypatch.setattr(scan, "ONE_SLICE_BYTES", one_slice)
    rows = rows_with_hot_key()
    frame = table(rows, "id long, key string, at long, v long")
    got = ordered_scan(frame, ["key"], [F.col("at"), F.col("id")], [
        rank("r"), total("s", F.coalesce("v", F.lit(0))), last_known("l", F.col("v")), next_known("n", F.col("v")),
        previous("p", F.col("v")), following("f", F.col("v")), highest("m", F.col("v")), known_before("b", F.col("v"))])
    found = {r["id"]: r for r in got.collect()}
    assert len(found) == len(rows)
    for key in {r[1] for r in rows}:
        group = sorted((r for r in rows if r[1] == key), key=lambda r: (r[2], r[0]))
        running, last, top = 0, None, None
        for i, (number, _, _, v) in enumerate(group):
            assert found[number]["b"] == last
            running += v or 0
            last = v if v is not None else last
            top = v if top is None or (v is not None and v > top) else top
            nxt = next((g[3] for g in group[i:] if g[3] is not None), None)
            row = found[number]
            assert (row["r"], row["s"], row["l"], row["n"], row["m"]) == (i + 1, running, last, nxt, top)
            assert row["p"] == (group[i - 1][3] if i else None)
            assert row["f"] == (group[i + 1][3] if i + 1 < len(group) else None)


def test_hot_key_is_spread_over_slices(spark, table):
    frame = table([(i, "hot") for i in range(2000)], "id long, key string")
    sliced = slice_rows(frame, ["key"], [F.col("id")])
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert len(sizes) > 1 and max(sizes) < 1500


def test_top_per_key_is_exact_with_spread(table):
    frame = table([(i, "hot" if i % 3 else "cold", (i * 7919) % 1000) for i in range(900)], "id long, key string, at long")
    plain = top_per_key(frame, ["key"], [F.col("at"), F.col("id")], 50)
    spread = top_per_key(frame, ["key"], [F.col("at"), F.col("id")], 50, spread=F.col("id"))
    as_set = lambda t: {(r["key"], r["id"], r["position"]) for r in t.select("key", "id", "position").collect()}
    assert as_set(plain) == as_set(spread) and plain.count() == 100


@pytest.mark.parametrize("one_slice", [0, 1 << 30])
def test_second_scan_reuses_the_slices(table, monkeypatch, one_slice):
    monkeypatch.setattr(scan, "ONE_SLICE_BYTES", one_slice)
    frame = table([(i, "hot" if i % 4 else None, (i * 37) % 101) for i in range(300)], "id long, key string, v long")
    order = [F.col("v"), F.col("id")]
    once = ordered_scan(frame, ["key"], order, [rank("r")], keep=True).where("id % 2 = 0")
    twice = ordered_scan(once, ["key"], order, [previous("p", F.col("r")), rank("half")])
    assert twice.columns == ["id", "key", "v", "r", "p", "half"]
    rows = sorted(twice.where("key = 'hot'").collect(), key=lambda r: (r["v"], r["id"]))
    assert [r["half"] for r in rows] == list(range(1, len(rows) + 1))
    assert [r["p"] for r in rows] == [None] + [r["r"] for r in rows[:-1]]


def test_nothing_runs_before_the_result_is_wanted(spark, table):
    frame = table([(i, "hot" if i % 3 else "b", (i * 7919) % 1000) for i in range(900)], "id long, key string, at long")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("lazy", "frames are only built")
    try:
        order = [F.col("at"), F.col("id")]
        once = ordered_scan(frame, ["key"], order, [rank("r")], keep=True)
        twice = ordered_scan(once, ["key"], order, [previous("p", F.col("r"))])
        assert len(tracker.getJobIdsForGroup("lazy")) == 0
        assert twice.where("p = r - 1").count() == 898 and len(tracker.getJobIdsForGroup("lazy")) > 0
    finally:
        spark.sparkContext.setJobGroup("default", "")


def test_partitions_follow_the_size_of_the_table(spark, monkeypatch):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey")
    configured = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert scan.dealt(lines, scan.partitions_for(lines), "l_orderkey").rdd.getNumPartitions() == lines.rdd.getNumPartitions()
    monkeypatch.setattr(scan, "PARTITION_BYTES", 1 << 10)
    assert scan.partitions_for(lines) > configured
    assert scan.dealt(lines, scan.partitions_for(lines), "l_orderkey").rdd.getNumPartitions() == scan.partitions_for(lines)
