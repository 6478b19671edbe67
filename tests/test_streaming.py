import random

import pytest
from pyspark.sql import functions as F

from pubtrack.operators import ledger
from pubtrack.streaming import operators
from pubtrack.streaming.publish import PublishLoop
from pubtrack.streaming.runtime import drain

BASE = 1_704_067_200_000_000
SCHEMA = "id long, service string, us long, est long, act long"


@pytest.fixture
def log(spark, tmp_path):
    """Requests in three files that arrive in order, one file per micro-batch."""
    rng = random.Random(8)
    rows = sorted((BASE + rng.randrange(2 * 86_400_000_000), rng.choice(["hot", "hot", "cold"]), rng.choice([50, 400]), rng.randrange(60)) for _ in range(900))
    rows = [(i, s, us, e, a) for i, (us, s, e, a) in enumerate(rows)]
    for part in range(3):
        frame = spark.createDataFrame(rows[part * 300:(part + 1) * 300], SCHEMA)
        frame.coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    return spark.createDataFrame(rows, SCHEMA), stream


def same(stream, batch, columns):
    return sorted(map(tuple, stream.select(*columns).collect())) == sorted(map(tuple, batch.select(*columns).collect()))


def test_throttle_over_batches_equals_batch_twin(log):
    batch, stream = log
    got = drain(operators.throttle_stream(stream, "service", "id", "us", 600, 50))
    want = ledger.throttle(batch, ["service"], "id", F.floor(F.col("us") / 1_000_000), 600, 50)
    assert same(got, want, ["service", "id", "accepted_second"]) and want.count() > 100


def test_budget_over_batches_equals_batch_twin(log):
    batch, stream = log
    day = F.to_date(F.timestamp_micros("us")).cast("string")
    got = drain(operators.budget_stream(stream.withColumn("day", day), "day", ["us", "id"], "id", "est", "act", 3000, 80))
    want = ledger.daily_budget(batch.withColumn("day", day), "day", ["us", "id"], "id", "est", "act", 3000, 80)
    assert same(got, want, ["day", "id", "used"]) and want.count() > 50


def test_quota_over_batches_equals_batch_twin(log):
    batch, stream = log
    day = F.to_date(F.timestamp_micros("us")).cast("string")
    timed = stream.withColumn("day", day).withColumn("at", F.timestamp_micros("us")).withWatermark("at", "2 days")
    got = drain(operators.quota_stream(timed, "service", "day", "at", "id", 70))
    want = ledger.client_quota(batch.withColumn("day", day), ["service", "day"], [F.col("us"), F.col("id")], "id", 70)
    assert same(got.withColumn("quota_position", F.col("quota_position").cast("int")), want, ["service", "day", "id", "quota_position"])


def test_probe_over_batches_equals_batch_twin(log):
    batch, stream = log
    shape = lambda t: t.select("service", "us", "id", F.floor(F.col("est") / 100).alias("v"), (F.col("act") > 10).alias("probe"))
    got = drain(operators.probe_stream(shape(stream), "service", "us", "id", "v", "probe"))
    rows = shape(batch)
    want = ledger.change_probe(rows.where("probe").drop("probe"), rows.where("NOT probe").drop("probe", "v"), ["service"], "us", "id", "v")
    assert same(got, want, ["service", "id", "probe_status"])
    assert {r[0] for r in want.select("probe_status").distinct().collect()} >= {"baseline_recorded", "unchanged", "checked", "changed_pending"}


def test_publish_loop_never_publishes_twice(spark, tmp_path):
    root, source = str(tmp_path / "root"), tmp_path / "docs"
    rows = [(1, "good text"), (2, "bad"), (3, "good text"), (4, "another good"), (5, "bad")]
    for i, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, "doc long, text string").coalesce(1).write.mode("append").parquet(str(source))
    loop = PublishLoop(root, "doc", "text", "doc", F.length("text") > 5)
    stream = spark.readStream.schema("doc long, text string").option("maxFilesPerTrigger", 1).parquet(str(source))
    loop.run(stream)
    accepted = spark.read.parquet(f"{root}/accepted")
    assert sorted(r["doc"] for r in accepted.collect()) == [1, 4]
    batch = spark.createDataFrame(rows[3:], "doc long, text string")
    loop.handle(batch, 1)
    assert sorted(r["doc"] for r in spark.read.parquet(f"{root}/accepted").collect()) == [1, 4], "a retried batch replaces its own folder"
    status = {r["doc"]: r["status"] for r in spark.read.parquet(f"{root}/checks").collect()}
    assert status[3] == "already_known" and status[2] == "failed" and loop.rejected(accepted).count() >= 1


def test_late_days_have_their_own_outcome(spark, tmp_path):
    schema, day = "service string, id long, us long", 86_400_000_000
    for part in ([("a", 1, 2 * day)], [("a", 2, day), ("a", 3, 2 * day + 1_000_000_000)]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "late"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "late"))
    got = {(r["id"], r["outcome"]) for r in drain(operators.throttle_stream(stream, "service", "id", "us", 600, 50)).collect()}
    assert got == {(1, "accepted"), (2, "late"), (3, "accepted")}


def test_throttle_hands_one_row_of_a_second_to_its_service(log):
    batch, stream = log
    busy = batch.unionByName(batch.withColumn("id", F.col("id") + 1_000_000)).unionByName(batch.withColumn("us", F.lit(None).cast("long")))
    got = operators.first_of_seconds(busy, "service", "id", "us")
    want = batch.groupBy("service", (F.floor(F.col("us") / 1_000_000) * 1_000_000).alias("us")).agg(F.min("id").alias("id"))
    assert same(got, want, ["service", "id", "us"])
    plan = operators.throttle_stream(stream, "service", "id", "us", 600, 50)._jdf.queryExecution().logical().toString()
    assert "MapInPandas" in plan
