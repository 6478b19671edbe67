import pytest
from pyspark.sql import functions as F

from pubtrack.operators import generation, ranking
from pubtrack.functions.values import short_id


@pytest.fixture
def store(spark, tmp_path):
    return generation.GenerationStore(spark, str(tmp_path / "store"), "id", ["specialty", "list_number", "rank"])


def members(table, n):
    rows = table([("s1" if i % 3 else "s2", i) for i in range(n)], "specialty string, list_number long").withColumn(
        "id", short_id(F.concat_ws("|", "specialty", "list_number"), 32))
    return ranking.ordinal_rank(rows, ["specialty"], [F.col("list_number")])


def manifest(rows):
    return rows.groupBy("specialty").agg(F.count(F.lit(1)).alias("expected"))


def test_stage_validate_activate_rollback(store, table):
    first, second = members(table, 40), members(table, 60)
    assert store.active() is None
    assert store.stage(first, "v1") == 40
    store.activate("v1", store.validate("v1", manifest(first), "specialty", "rank"))
    assert store.active() == "v1" and store.rows("v1").count() == 40
    store.stage(second, "v2")
    assert store.active() == "v1", "the old generation stays live while a new one is staged"
    store.activate("v2", store.validate("v2", manifest(second), "specialty", "rank"))
    assert store.active() == "v2"
    store.rollback("v1")
    assert store.active() == "v1"
    record = first.first()["id"]
    assert store.point_lookup("v1", record).count() == 1


def test_staging_resumes_and_refuses_foreign_rows(store, table):
    rows = members(table, 40)
    store.stage(rows.where("list_number < 10"), "v1")
    assert store.stage(rows, "v1") == 30 and store.rows("v1").count() == 40
    assert store.stage(rows, "v1") == 0
    with pytest.raises(ValueError, match="outside"):
        store.stage(rows.where("list_number < 5"), "v1")


def test_late_rows_invalidate_the_validation(store, table):
    rows = members(table, 40)
    store.stage(rows.where("list_number < 30"), "v1")
    seen = store.digest("v1")
    store.stage(rows, "v1")
    with pytest.raises(ValueError, match="changed"):
        store.activate("v1", seen)
    assert store.active() is None


def test_gates_and_recovery(store, table):
    rows = members(table, 20)
    store.stage(rows.where("rank <> 3"), "v1")
    with pytest.raises(ValueError, match="rank_gap_or_repeat|count_mismatch"):
        store.validate("v1", manifest(rows), "specialty", "rank")
    with pytest.raises(ValueError):
        store.rollback("v1")
    store.recover("v1")
    store.stage(rows, "v1")
    store.activate("v1", store.validate("v1", manifest(rows), "specialty", "rank"))
    with pytest.raises(ValueError, match="immutable"):
        store.recover("v1")


def test_blocks_hold_at_most_their_limit(table):
    blocks = generation.assign_blocks(members(table, 300), "id", prefix=1, block_rows=8)
    sizes = generation.block_sizes(blocks, ["id", "rank"], most_rows=8)
    assert sizes.where("NOT within_limits").count() == 0 and sizes.agg(F.sum("block_rows")).first()[0] == 300
    packed = generation.pack_blocks(blocks, "id", ["id", "rank"])
    back = generation.unpack_blocks(packed, "id string, rank long")
    assert sorted(map(tuple, back.select("id", "rank").collect())) == sorted(map(tuple, members(table, 300).select("id", "rank").collect()))
