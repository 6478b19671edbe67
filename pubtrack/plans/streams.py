"""The stream operators run over the event and document tables until everything is processed. Their
oracles are those of the batch twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubtrack.plans.admission import BUDGET, THROTTLE, write_ledger_sql, write_log
from pubtrack.plans.registry import ORACLES, query
from pubtrack.streaming import operators, timed
from pubtrack.streaming.publish import PublishLoop
from pubtrack.streaming.runtime import ROCKS, drain, run_folder, table_stream


def events(spark, d):
    return table_stream(spark, d, "events").withColumn("us", F.unix_micros("ts"))


@query("stream_throttle", THROTTLE.format(service="'gate'", gap=300, cap=96) + "SELECT t.service, t.s AS accepted_second, t.event_id FROM t JOIN a ON a.service = t.service AND a.s = t.s")
def _(spark, d):
    requests = events(spark, d).withColumn("service", F.lit("gate"))
    return drain(operators.throttle_stream(requests, "service", "event_id", "us", 300, 96)).where("outcome = 'accepted'").drop("outcome")


@query("stream_client_quota", """
WITH r AS (SELECT event_id, event_type, ts::DATE::VARCHAR AS day, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, event_type, day, n AS quota_position FROM r WHERE n <= 60
""")
def _(spark, d):
    requests = events(spark, d).withColumn("day", F.to_date("ts").cast("string")).withWatermark("ts", "1 hour")
    return drain(operators.quota_stream(requests, "event_type", "day", "ts", "event_id", 60))


@query("stream_daily_budget", BUDGET + "SELECT day::VARCHAR AS day, event_id, estimate, actual, CAST(used AS BIGINT) AS used FROM f WHERE ok")
def _(spark, d):
    requests = events(spark, d).select("event_id", "us", F.to_date("ts").cast("string").alias("day"), (F.ceil(F.col("value") / 5) * 100).alias("estimate"),
                                       (F.col("value").cast("long") * 20).alias("actual"))
    return drain(operators.budget_stream(requests, "day", ["us", "event_id"], "event_id", "estimate", "actual", 40000, 150))


@query("stream_leases", """
WITH j AS (SELECT user_id AS job_id, epoch_us(min(ts)) AS started_us FROM events WHERE event_type = 'signup' GROUP BY 1),
c AS (SELECT j.job_id, min(epoch_us(e.ts)) AS f FROM j JOIN events e ON e.user_id = j.job_id AND e.event_type = 'purchase' AND epoch_us(e.ts) BETWEEN started_us AND started_us + 72000000000 GROUP BY 1)
SELECT j.job_id, started_us, CASE WHEN f IS NULL THEN 'failed' ELSE 'completed' END AS job_status, coalesce(f, started_us + 72000000000) AS ended_us FROM j LEFT JOIN c USING (job_id)
WHERE f IS NOT NULL OR started_us + 72000000000 < (SELECT epoch_us(max(ts)) - 3600000000 FROM events)
""")
def _(spark, d):
    log = events(spark, d).where("event_type IN ('signup', 'purchase')").withColumn("job_id", F.col("user_id")).withColumn(
        "starts", F.col("event_type") == "signup").withWatermark("ts", "1 hour").select("job_id", "ts", "us", "starts")
    return drain(operators.lease_stream(log, "job_id", "us", "starts", 72000))


@query("stream_write_ledger", write_ledger_sql("""(SELECT max(epoch_us(ts) + CASE WHEN event_id % 11 <> 0 THEN CAST(trunc(value) AS BIGINT) * 120000000 ELSE 0 END) // 1000 * 1000 - 3600000000 FROM events)"""))
def _(spark, d):
    log = write_log(events(spark, d)).withColumn("time", F.timestamp_micros("at")).withWatermark("time", "1 hour")
    return drain(timed.write_ledger_stream(log, "user_id", "at", "event_id", "reserved", "written", 100, 36_000_000_000), conf=ROCKS)


@query("stream_change_probe", ORACLES["change_probe"])
def _(spark, d):
    log = events(spark, d).where("event_type IN ('view', 'click', 'purchase')").select(
        "user_id", "us", "event_id", (F.col("value") / 25).cast("long").alias("validator"), (F.col("event_type") != "purchase").alias("probe"))
    return drain(operators.probe_stream(log, "user_id", "us", "event_id", "validator", "probe")).select("event_id", "probe_status")


@query("stream_watchdog", ORACLES["watchdog_retries"])
def _(spark, d):
    log = events(spark, d).select("user_id", "us", "event_id", F.col("event_type").isin("error", "signup").alias("needs"), (F.col("event_type") == "error").alias("gone"))
    return drain(operators.watchdog_stream(log, "user_id", "us", "event_id", "needs", "gone"))


@query("stream_completions", """
SELECT a.event_id, b.event_id AS completion_id FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'signup' AND b.event_type = 'purchase'
 AND b.ts >= a.ts - INTERVAL 1 SECOND AND b.ts <= a.ts + INTERVAL 6 HOUR
""")
def _(spark, d):
    e = events(spark, d)
    requests = e.where("event_type = 'signup'").select("user_id", "event_id", F.col("ts").alias("created_at"))
    done = e.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("completion_id"), F.col("ts").alias("attempt_at"))
    return drain(operators.completion_stream(requests, done, "user_id", "created_at", "attempt_at", horizon="6 hours")).select("event_id", "completion_id")


@query("stream_first_completions", """
SELECT a.user_id, a.event_id, epoch_us(a.ts) AS created_us, min(epoch_us(b.ts)) AS completed_us FROM events a LEFT JOIN events b ON a.user_id = b.user_id AND b.event_type = 'purchase'
 AND epoch_us(b.ts) BETWEEN epoch_us(a.ts) - 1000000 AND epoch_us(a.ts) + 86400000000
WHERE a.event_type = 'signup' AND epoch_us(a.ts) + 86400000000 < (SELECT epoch_us(max(ts)) // 1000 * 1000 - 3600000000 FROM events WHERE event_type IN ('signup', 'purchase')) GROUP BY ALL
""")
def _(spark, d):
    log = events(spark, d).where("event_type IN ('signup', 'purchase')").withWatermark("ts", "1 hour").select("ts", "user_id", "event_id", "us", (F.col("event_type") == "signup").alias("asks"))
    return drain(timed.first_completion_stream(log, "user_id", "event_id", "us", "asks", 86_400_000_000), conf=ROCKS)


@query("stream_deduplicated", """
SELECT DISTINCT user_id, event_type FROM events
""")
def _(spark, d):
    return drain(operators.dedupe_stream(events(spark, d), ["user_id", "event_type"], "ts", "40 days").select("user_id", "event_type"))


@query("stream_activity_windows", """
WITH w AS (SELECT epoch_us(ts) // 1800000000 AS half_hour, count(*) AS checks, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1)
SELECT * FROM w WHERE (half_hour + 1) * 1800000000 <= (SELECT epoch_us(max(ts)) // 1000 * 1000 - 600000000 FROM events)
""")
def _(spark, d):
    done = drain(operators.window_stream(events(spark, d), "ts", F.col("event_type") == "error"))
    return done.select(F.floor(F.unix_micros("start") / 1_800_000_000).alias("half_hour"), "checks", "failed")


@query("stream_publish_loop", """
SELECT doc_id, CASE WHEN doc_id <> min(doc_id) OVER (PARTITION BY text) THEN 'already_known' WHEN n_chars >= 500 THEN 'read' ELSE 'failed' END AS status FROM documents
""")
def _(spark, d):
    root = run_folder(spark)
    # The smallest id of a text is the one to publish, in whatever file it is, so all files are one batch.
    PublishLoop(root, "doc_id", "text", "doc_id", F.col("n_chars") >= 500).run(table_stream(spark, d, "documents", files_per_trigger=1_000_000))
    return spark.read.parquet(f"{root}/checks").select("doc_id", "status")
