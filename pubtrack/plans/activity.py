"""Queries over the check, run and request log. A resource or service is an event user, a run is one
user's day, a failure is an ``error`` event."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubtrack.functions import values
from pubtrack.operators import filters, history, inventory, operations, queues
from pubtrack.operators.scan import ordered_scan, previous, top_per_key
from pubtrack.plans.registry import query
from pubtrack.session import load


def events(spark, d):
    """Events with the instant and its microseconds."""
    table = load(spark, d, "events")
    return table.withColumn("at", F.col("ts").cast("timestamp")).withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


def by_time():
    return [F.col("us"), F.col("event_id")]


US = "epoch_us(ts)"


@query("run_log_ingest", """
SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'failed' END AS status,
 CASE WHEN value >= 0 AND value < 1e12 THEN value END AS elapsed_seconds, CASE WHEN regexp_full_match(user_id::VARCHAR, '[0-9]{1,2}') THEN user_id::VARCHAR END AS run_code FROM events
""")
def _(spark, d):
    parsed = events(spark, d).withColumn("p", F.from_json("props", "k bigint"))
    return parsed.select("event_id", F.col("p.k").alias("k"), values.closed(F.col("event_type"), ["view", "click"], "failed").alias("status"),
                         values.clean_number(F.col("value").cast("string")).alias("elapsed_seconds"),
                         values.clean_text(F.col("user_id").cast("string"), "[0-9]{1,2}").alias("run_code"))


@query("payload_probe", """
SELECT event_id, json_extract_string(props, '$.k') AS k_text, json_extract_string(props, '$.missing.path') IS NULL AS path_absent FROM events
""")
def _(spark, d):
    return events(spark, d).select("event_id", F.get_json_object("props", "$.k").alias("k_text"),
                                   F.get_json_object("props", "$.missing.path").isNull().alias("path_absent"))


@query("scalar_sanitizers", """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') END AS stamp,
 CASE WHEN event_id % 4 <> 0 THEN event_type END AS code, CASE WHEN event_id % 5 <> 0 THEN event_id ELSE 0 END AS record_count FROM events
""")
def _(spark, d):
    e = events(spark, d)
    clock = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    stamp = values.clean_stamp(F.when(F.col("event_id") % 3 == 0, F.concat(clock, F.lit("Z"))).otherwise(clock))
    code = values.clean_code(F.when(F.col("event_id") % 4 != 0, F.col("event_type")).otherwise(F.concat("event_type", F.lit(" !"))))
    count = values.clean_count(F.when(F.col("event_id") % 5 != 0, F.col("event_id").cast("string")).otherwise("-1"))
    return e.select("event_id", F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("stamp"), code.alias("code"), count.alias("record_count"))


@query("run_intervals", """
SELECT event_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events
""")
def _(spark, d):
    scanned = ordered_scan(events(spark, d).select("user_id", "event_id", "us"), ["user_id"], by_time(), [previous("before", F.col("us"))])
    return scanned.select("event_id", (F.col("us") - F.col("before")).alias("gap_us"))


@query("median_intervals", """
WITH g AS (SELECT user_id, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)
SELECT user_id, median(gap) AS median_interval FROM g WHERE gap IS NOT NULL GROUP BY 1
""")
def _(spark, d):
    runs = events(spark, d).select("user_id", "event_id", "us")
    return operations.interval_medians(runs, ["user_id"], F.floor(F.col("us") / 1_000_000), by_time())


@query("status_matrix", """
WITH p AS (SELECT unnest(['view', 'signup', 'purchase', 'click', 'error', 'refund']) AS phase), s AS (SELECT unnest(['low', 'mid', 'high', 'none']) AS status),
c AS (SELECT event_type AS phase, CASE WHEN value < 10 THEN 'low' WHEN value < 50 THEN 'mid' ELSE 'high' END AS status, count(*) AS n FROM events GROUP BY 1, 2)
SELECT phase, status, coalesce(n, 0) AS run_count FROM p CROSS JOIN s LEFT JOIN c USING (phase, status)
""")
def _(spark, d):
    rated = load(spark, d, "events").select(F.col("event_type").alias("phase"), F.when(F.col("value") < 10, "low").when(
        F.col("value") < 50, "mid").otherwise("high").alias("status"))
    return operations.status_matrix(rated, "phase", "status", ["view", "signup", "purchase", "click", "error", "refund"],
                                    ["low", "mid", "high", "none"])


@query("closed_status_counts", """
SELECT CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus ELSE 'pending' END AS status, count(*) AS record_count FROM orders GROUP BY 1
""")
def _(spark, d):
    return operations.closed_counts(load(spark, d, "orders"), F.col("o_orderstatus"), ["F", "O"], "pending")


@query("trial_progress", """
SELECT user_id, least(672, (max(epoch(ts)::BIGINT) - min(epoch(ts)::BIGINT)) // 1800)::BIGINT AS elapsed_windows,
 CASE WHEN max(epoch(ts)::BIGINT) - min(epoch(ts)::BIGINT) >= 14 * 86400 THEN 'evaluation_pending' ELSE 'collecting' END AS trial_status
FROM (SELECT user_id, make_timestamp(epoch_us(ts) // 1000000 * 1000000) AS ts FROM events) GROUP BY 1
""")
def _(spark, d):
    return operations.trial_progress(events(spark, d), ["user_id"], F.floor(F.col("us") / 1_000_000))


@query("run_outcomes", """
SELECT user_id, ts::DATE::VARCHAR AS day, CASE WHEN bool_or(event_type = 'error') THEN 'failed' WHEN bool_and(event_type = 'purchase') THEN 'success' ELSE 'partial' END AS outcome
FROM events GROUP BY 1, 2
""")
def _(spark, d):
    phases = load(spark, d, "events").select("user_id", F.to_date("ts").cast("string").alias("day"), F.when(
        F.col("event_type") == "purchase", "success").otherwise(F.col("event_type")).alias("status"))
    return operations.run_outcomes(phases, ["user_id", "day"], "status", ["error"])


@query("operational_failures", """
SELECT ts::DATE::VARCHAR AS day, bool_or(event_type = 'error' AND NOT (value < 20) AND NOT (user_id % 2 = 0 AND value > 60)) AS operational_failure,
 bool_and(event_type <> 'error') AS complete FROM events GROUP BY 1
""")
def _(spark, d):
    checks = load(spark, d, "events").withColumn("day", F.to_date("ts").cast("string"))
    code = F.when(F.col("value") < 20, "timeout").otherwise("http_error")
    return operations.operational_failure(checks, ["day"], F.col("event_type") != "error", code, ["timeout", "discovery_limit"],
                                          (F.col("user_id") % 2 == 0) & (F.col("value") > 60))


@query("freshness", """
SELECT user_id, CASE WHEN bool_and(event_type <> 'error') THEN 'completed' ELSE 'partial' END AS status, count(*) FILTER (event_type = 'error') AS failed_checks FROM events GROUP BY 1
""")
def _(spark, d):
    ok = F.col("event_type") != "error"
    return load(spark, d, "events").groupBy("user_id").agg(
        F.when(F.bool_and(ok), "completed").otherwise("partial").alias("status"), F.count_if(~ok).alias("failed_checks"))


@query("attempt_correlation", """
WITH runs AS (SELECT user_id, event_id AS run_id, ts AS a, ts + to_milliseconds((value * 60000)::BIGINT) AS b FROM events WHERE event_type = 'signup')
SELECT e.event_id, r.run_id FROM events e LEFT JOIN runs r ON r.user_id = e.user_id AND e.ts >= a - INTERVAL 1 SECOND AND e.ts <= b + INTERVAL 1 SECOND
WHERE e.event_type = 'view'
""")
def _(spark, d):
    e = events(spark, d)
    runs = e.where("event_type = 'signup'").select(
        "user_id", F.col("event_id").alias("run_id"), F.col("at").alias("started_at"),
        (F.col("at") + F.make_dt_interval(secs=(F.floor(F.col("value") * 60000 + 0.5) / 1000).cast("decimal(18,6)"))).alias("ended_at"))
    return operations.correlate_attempts(e.where("event_type = 'view'"), runs, "user_id", "at").select("event_id", "run_id")


@query("three_way_consistency", """
WITH a AS (SELECT user_id, max(event_id) AS v, count(*) AS n, max(ts) AS c FROM events WHERE event_type <> 'error' GROUP BY 1),
b AS (SELECT user_id, max(event_id) AS v, count(*) FILTER (event_type <> 'error') AS n, max(ts) AS c FROM events GROUP BY 1),
c AS (SELECT user_id, max(event_id) AS v, count(*) AS n, max(ts) AS c FROM events WHERE event_type <> 'error' AND value < 150 GROUP BY 1)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.v = b.v AND b.v = c.v AND a.n = b.n AND b.n = c.n AND a.c = b.c AND b.c = c.c, false) AS consistent
FROM b LEFT JOIN a ON a.user_id = b.user_id LEFT JOIN c ON c.user_id = b.user_id
""")
def _(spark, d):
    e = events(spark, d)

    def summary(table, count=F.count(F.lit(1))):
        return table.groupBy("user_id").agg(F.max("event_id").alias("version"), count.alias("records"), F.max("at").alias("checked"))

    fine = e.where("event_type <> 'error'")
    return operations.consistency(summary(fine), summary(e, F.count_if(F.col("event_type") != "error")),
                                  summary(fine.where("value < 150")), ["user_id"])


@query("health_assessment", """
WITH h AS (SELECT user_id, max(ts) FILTER (event_type = 'view') AS p, max(ts) FILTER (event_type = 'click') AS c, max(ts) FILTER (event_type IN ('click', 'signup')) AS ac,
  count(*) AS n, count(*) FILTER (event_type = 'error') AS bad, arg_max(event_type, (ts, event_id)) AS last_type FROM events GROUP BY 1), q AS (SELECT max(ts) AS now FROM events),
i AS (SELECT user_id, CASE WHEN p IS NULL THEN ['publication_unavailable'] ELSE list_filter([
 CASE WHEN epoch_us(now) - epoch_us(p) > 5400000000 THEN 'publication_stale' END,
 CASE WHEN c IS NULL OR epoch_us(now) - epoch_us(c) > 5400000000 THEN 'position_stale' END,
 CASE WHEN n % 2 = 1 THEN 'origin_unverified' END,
 CASE WHEN c IS DISTINCT FROM ac OR c IS NULL THEN 'publication_mismatch' END,
 CASE WHEN last_type = 'error' THEN 'collection_failed' END, CASE WHEN bad > 15 THEN 'coverage_partial' END, CASE WHEN n % 3 = 0 THEN 'recovery_unavailable' END], lambda x: x IS NOT NULL) END AS issues,
 p IS NOT NULL AND epoch_us(now) - epoch_us(p) <= 1200000000 AS fresh FROM h, q),
a AS (SELECT *, list_filter(issues, lambda x: x NOT IN ('coverage_partial', 'recovery_unavailable') AND NOT (fresh AND x = 'publication_mismatch')) AS act FROM i)
SELECT user_id, array_to_string(issues, ',') AS issues, len(act) > 0 AS needs_refresh, CASE WHEN list_contains(issues, 'publication_unavailable') THEN 'unavailable'
 WHEN len(act) > 0 THEN 'degraded' WHEN len(issues) > 0 THEN 'partial' ELSE 'healthy' END AS health FROM a
""")
def _(spark, d):
    e = events(spark, d)
    kind = F.col("event_type")
    summary = e.groupBy("user_id").agg(
        F.max(F.when(kind == "view", F.col("at"))).alias("published_at"), F.max(F.when(kind == "click", F.col("at"))).alias("checked_at"),
        F.max(F.when(kind.isin("click", "signup"), F.col("at"))).alias("active_checked_at"), F.count(F.lit(1)).alias("n"),
        F.count_if(kind == "error").alias("bad"), F.max_by("event_type", F.struct("us", "event_id")).alias("last_type"))
    now = e.agg(F.max("at").alias("now"))
    health = summary.withColumn("_one", F.lit(1)).join(F.broadcast(now.withColumn("_one", F.lit(1))), "_one").select(
        "user_id", "published_at", "checked_at", "active_checked_at", "now", F.lit("v").alias("active_version"), F.lit("v").alias("version_id"),
        F.col("n").alias("record_count"), F.col("n").alias("row_count"), (F.col("n") % 2 == 0).alias("origin_check_complete"),
        F.lit("verified").alias("position_status"), F.when(F.col("last_type") == "error", "failed").otherwise("success").alias("run_status"),
        F.lit("completed").alias("vacancy_status"), (F.col("bad") <= 15).alias("coverage_complete"), F.lit(0).alias("pending_documents"),
        F.lit(0).alias("unavailable_documents"), F.lit("ready").alias("cache_status"),
        F.when(F.col("n") % 3 == 0, "failed").otherwise("verified").alias("recovery_status"))
    rated = operations.assess_health(health, F.col("now"))
    return rated.select("user_id", F.array_join("issues", ",").alias("issues"), "needs_refresh", "health")


@query("receipt_upsert", """
SELECT user_id, event_type AS kind, min(epoch_us(ts)) AS received_at, max(epoch_us(ts)) AS last_received_at, count(*) AS attempts, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2
""")
def _(spark, d):
    e = events(spark, d).withColumn("kind", F.col("event_type"))
    half = operations.receipts(e.where("value < 20"), ["user_id", "kind"], "us", "event_id", ["value"])
    rest = operations.receipts(e.where("NOT value < 20"), ["user_id", "kind"], "us", "event_id", ["value"])
    return operations.merge_receipts(half, rest, ["user_id", "kind"], ["value"])


@query("pending_receipts", """
SELECT event_type AS kind, count(*) FILTER (value < 30) AS pending_documents, CAST(sum(CAST(trunc(value) AS BIGINT)) AS BIGINT) AS human_seconds FROM events GROUP BY 1
""")
def _(spark, d):
    return load(spark, d, "events").groupBy(F.col("event_type").alias("kind")).agg(
        F.count_if(F.col("value") < 30).alias("pending_documents"), F.sum(F.col("value").cast("long")).alias("human_seconds"))


@query("run_ledger", """
SELECT r AS run_id, epoch_us(a) AS started_us, epoch_us(CASE WHEN b >= a THEN b END) AS ended_us, (epoch_us(CASE WHEN b >= a THEN b END) - epoch_us(a)) / 1000000 AS elapsed_seconds FROM (
 SELECT user_id || '|' || ts::DATE AS r, min(ts) FILTER (event_type = 'view') AS a, max(ts) FILTER (event_type = 'purchase') AS b, bool_or(event_type = 'error' AND value > 100) AS known FROM events GROUP BY 1)
WHERE a IS NOT NULL AND NOT known
""")
def _(spark, d):
    e = events(spark, d).withColumn("run_id", F.concat_ws("|", F.col("user_id").cast("string"), F.to_date("ts").cast("string")))
    known = e.where("event_type = 'error' AND value > 100").select("run_id")
    runs = operations.run_ledger(e, known, "run_id", "at", F.col("event_type") == "view", F.col("event_type") == "purchase")
    return runs.select("run_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("ended_at").alias("ended_us"), "elapsed_seconds")


@query("forward_only_checks", """
SELECT user_id, max(CASE WHEN event_type = 'view' OR event_type = 'click' THEN epoch_us(ts) END) AS checked_us FROM events GROUP BY 1
""")
def _(spark, d):
    e = events(spark, d)
    stored = e.groupBy("user_id").agg(F.max(F.when(F.col("event_type") == "view", F.col("us"))).alias("checked_us"))
    updates = e.where("event_type = 'click'").select("user_id", F.col("us").alias("checked_us"))
    return operations.forward_only(stored, updates, ["user_id"], "checked_us")


@query("sightings", """
SELECT user_id, min(epoch_us(ts)) AS first_seen_at, max(epoch_us(ts)) AS last_seen_at, max(epoch_us(ts)) FILTER (event_type = 'click') AS attempted_at FROM events GROUP BY 1
""")
def _(spark, d):
    return history.sightings(events(spark, d), ["user_id"], "us", F.col("event_type") == "click")


@query("failure_backoff", """
WITH f AS (SELECT event_id, user_id, ts, (event_type = 'error')::INT AS bad, sum((event_type = 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS tot FROM events),
g AS (SELECT *, coalesce(max(CASE WHEN bad = 0 THEN tot END) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS base FROM f)
SELECT event_id, CAST(tot - base AS BIGINT) AS failures, CASE WHEN tot > base THEN CAST(least(21600, 3600 * power(2, least(tot - base, 5) - 1)) AS BIGINT) END AS wait_seconds FROM g
""")
def _(spark, d):
    checks = events(spark, d).select("event_id", "user_id", "us", "event_type")
    streaks = queues.failure_streaks(checks, ["user_id"], by_time(), F.col("event_type") == "error")
    return streaks.select("event_id", "failures", queues.backoff_seconds(F.col("failures")).alias("wait_seconds"))


# State after state: failures, end of the wait and kind of the plain entry (p) and of the browser's (b).
PRUNED = """
WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS t, event_type IN ('error', 'click', 'view') AS bad, event_type = 'click' AS barred, event_id % 3 = 0 AS web,
  CASE WHEN event_id % 10 = 0 THEN CAST(trunc(value) AS BIGINT) * 600 END AS floor, row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_id) AS n FROM events),
f(user_id, n, event_id, outcome, failures, next_attempt, pf, pu, pb, bf, bu) AS (SELECT user_id, 0::BIGINT, NULL::BIGINT, '', NULL::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, false, 0::BIGINT, 0::BIGINT FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT user_id, n, event_id, CASE WHEN held THEN 'deferred' WHEN bad THEN 'failed' ELSE 'read' END, CASE WHEN NOT held AND bad THEN k END, CASE WHEN NOT held AND bad THEN u END,
  CASE WHEN held THEN pf1 WHEN NOT bad THEN 0 WHEN scope THEN pf1 ELSE k END, CASE WHEN held THEN pu1 WHEN NOT bad THEN 0 WHEN scope THEN pu1 ELSE u END, CASE WHEN held OR (bad AND scope) THEN pb ELSE barred END,
  CASE WHEN held THEN bf1 WHEN NOT bad AND web THEN 0 WHEN bad AND scope THEN k ELSE bf1 END, CASE WHEN held THEN bu1 WHEN NOT bad AND web THEN 0 WHEN bad AND scope THEN u ELSE bu1 END
 FROM (SELECT *, t + greatest(coalesce(floor, 0), least(21600, 3600 * (1 << (k - 1)::INT)))::BIGINT AS u FROM (SELECT *, least(5, CASE WHEN scope THEN bf1 ELSE pf1 END + 1) AS k,
  (pu1 > t AND NOT (web AND pb)) OR (web AND bu1 > t) AS held FROM (SELECT r.*, f.pb, r.web AND r.barred AS scope, CASE WHEN f.pu > r.t - 604800 THEN f.pf ELSE 0 END AS pf1, CASE WHEN f.pu > r.t - 604800 THEN f.pu ELSE 0 END AS pu1,
   CASE WHEN f.bu > r.t - 604800 THEN f.bf ELSE 0 END AS bf1, CASE WHEN f.bu > r.t - 604800 THEN f.bu ELSE 0 END AS bu1 FROM f JOIN r ON r.user_id = f.user_id AND r.n = f.n + 1))))
SELECT user_id, event_id, outcome, failures, next_attempt FROM f WHERE n > 0
"""


@query("pruned_backoff", PRUNED)
def _(spark, d):
    attempts = events(spark, d).select(
        "user_id", "event_id", F.floor(F.col("us") / 1_000_000).alias("second"), F.col("event_type").isin("error", "click", "view").alias("failed"), (F.col("event_type") == "click").alias("challenge"),
        (F.col("event_id") % 3 == 0).alias("browser"), F.when(F.col("event_id") % 10 == 0, F.col("value").cast("long") * 600).alias("retry_after"))
    return queues.pruned_backoff(attempts, ["user_id"], "second", "event_id", "failed", "challenge", "browser", "retry_after")


@query("watchdog_carry", """
WITH m AS (SELECT *, event_type = 'error' AS bad, coalesce(lag(event_type = 'error') OVER w, false) AS was FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, CASE WHEN bad THEN last_value(CASE WHEN bad AND NOT was THEN epoch_us(ts) END IGNORE NULLS) OVER w END AS first_failure,
 last_value(CASE WHEN NOT bad THEN epoch_us(ts) END IGNORE NULLS) OVER w AS last_good FROM m WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)
""")
def _(spark, d):
    seen = events(spark, d).select("event_id", "user_id", "us", "event_type")
    return queues.carry_state(seen, ["user_id"], by_time(), F.col("event_type") == "error", "us").select("event_id", "first_failure", "last_good")


@query("pacing_violations", """
WITH g AS (SELECT event_id, event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS gap FROM events)
SELECT event_id, event_type, gap FROM g WHERE gap < 600000000
""")
def _(spark, d):
    requests = events(spark, d).select("event_id", "event_type", "us")
    return queues.pacing_violations(requests, ["event_type"], by_time(), F.col("us"), 600_000_000).drop("us")


@query("as_of_signup", """
WITH s AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'signup')
SELECT c.event_id, (SELECT arg_max(s.event_id, (s.ts, s.event_id)) FROM s WHERE s.user_id = c.user_id AND s.ts <= c.ts) AS signup_id FROM events c WHERE c.event_type = 'click'
""")
def _(spark, d):
    e = events(spark, d).select("event_id", "user_id", "us", "event_type")
    signups = e.where("event_type = 'signup'").withColumn("signup", F.col("event_id"))
    found = history.as_of_previous(e.where("event_type = 'click'"), signups, ["user_id"], "us", "event_id", "signup", "last")
    return found.select("event_id", F.col("last.value").alias("signup_id"))


@query("latest_known_check", """
SELECT user_id, max(epoch_us(ts)) FILTER (ts <= TIMESTAMP '2024-01-20 12:00:00' AND event_type IN ('view', 'click', 'purchase')) AS checked_at FROM events
WHERE event_type IN ('view', 'click', 'purchase') GROUP BY 1
""")
def _(spark, d):
    e = events(spark, d)
    streams = [e.where(F.col("event_type") == kind) for kind in ("view", "click", "purchase")]
    now = F.unix_micros(F.lit("2024-01-20 12:00:00").cast("timestamp"))
    return history.latest_known_check(streams, ["user_id"], "us", now)


@query("cached_fallback", """
WITH w AS (SELECT user_id, CASE WHEN user_id % 3 = 0 THEN 'timeout' ELSE 'forbidden' END AS error FROM events GROUP BY 1),
f AS (SELECT user_id, max(epoch_us(ts)) AS v FROM events WHERE event_type = 'view' AND value > 100 GROUP BY 1), c AS (SELECT user_id, max(epoch_us(ts)) AS v FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT w.user_id, CASE WHEN f.v IS NOT NULL THEN 'fresh' WHEN c.v IS NOT NULL AND error = 'timeout' THEN 'cached' ELSE 'unavailable' END AS source_status,
 CASE WHEN f.v IS NOT NULL THEN f.v WHEN error = 'timeout' THEN c.v END AS origin_checked_at FROM w LEFT JOIN f USING (user_id) LEFT JOIN c USING (user_id)
""")
def _(spark, d):
    e = events(spark, d)
    wanted = e.select("user_id").distinct().withColumn("error", F.when(F.col("user_id") % 3 == 0, "timeout").otherwise("forbidden"))
    return history.cached_fallback(wanted, e.where("event_type = 'view' AND value > 100"), e.where("event_type = 'click'"), ["user_id"], "error",
                                   ["timeout"], "us").select("user_id", "source_status", "origin_checked_at")


@query("run_retention", """
WITH q AS (SELECT max(ts) AS now FROM events), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events, q WHERE ts >= now - INTERVAL 20 DAY)
SELECT event_id, event_type FROM r WHERE rn <= 1024
""")
def _(spark, d):
    e = events(spark, d).select("event_id", "event_type", "at")
    now = e.agg(F.max("at").alias("now")).withColumn("_one", F.lit(1))
    timed = e.withColumn("_one", F.lit(1)).join(F.broadcast(now), "_one")
    kept, _ = history.keep_recent(timed, ["event_type"], "event_id", "at", F.col("now"), days=20)
    return kept.select("event_id", "event_type")


@query("discarded_runs", """
WITH q AS (SELECT max(ts) AS now FROM events)
SELECT event_type, count(*) - least(1024, count(*) FILTER (ts >= now - INTERVAL 20 DAY)) AS discarded_runs FROM events, q GROUP BY 1
""")
def _(spark, d):
    e = events(spark, d).select("event_id", "event_type", "at")
    now = e.agg(F.max("at").alias("now")).withColumn("_one", F.lit(1))
    timed = e.withColumn("_one", F.lit(1)).join(F.broadcast(now), "_one")
    return history.keep_recent(timed, ["event_type"], "event_id", "at", F.col("now"), days=20)[1]


@query("retention_candidates", """
WITH q AS (SELECT max(o_orderdate) AS now FROM orders), r AS (SELECT o_orderkey, o_custkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate END AS c, o_orderstatus = 'P' AS prot FROM orders),
d AS (SELECT r.*, now, row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, o_orderkey DESC) AS rn FROM r, q WHERE c IS NOT NULL)
SELECT o_orderkey FROM d WHERE rn > 2 AND c < now - INTERVAL 90 DAY AND NOT prot
""")
def _(spark, d):
    orders = load(spark, d, "orders").withColumn("_one", F.lit(1))
    now = orders.groupBy("_one").agg(F.max("o_orderdate").cast("timestamp").alias("now"))
    records = orders.join(F.broadcast(now), "_one").withColumn("checked", F.when(F.col("o_orderkey") % 11 != 0, F.col("o_orderdate").cast("timestamp")))
    return history.retention_candidates(records, ["o_custkey"], "o_orderkey", "checked", F.col("o_orderstatus") == "P", F.col("now")).select("o_orderkey")


@query("feed_continuity", """
WITH s AS (SELECT o_custkey, o_orderkey, o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS b FROM orders)
SELECT o_custkey, o_orderkey FROM s WHERE o_orderdate > b
""")
def _(spark, d):
    entries = load(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return queues.feed_continuity(entries, ["o_custkey"], [F.col("o_orderkey")], "o_orderdate").select("o_custkey", "o_orderkey")


@query("repeated_pages", """
SELECT sha256(o_custkey || '|' || o_orderpriority || '|' || o_orderstatus) AS digest, count(*) AS copies FROM orders GROUP BY 1 HAVING count(*) > 1
""")
def _(spark, d):
    digest = F.sha2(F.concat_ws("|", F.col("o_custkey").cast("string"), "o_orderpriority", "o_orderstatus"), 256)
    return load(spark, d, "orders").groupBy(digest.alias("digest")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1")


QUEUE = """
WITH i AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 17 <> 0 THEN o_orderdate::DATE END AS day, CAST(left(o_orderpriority, 1) AS INTEGER) AS pr,
 CASE WHEN o_orderstatus <> 'F' THEN strftime(o_orderdate, '%Y-%m') ELSE '' END AS att FROM orders),
n AS (SELECT *, CASE WHEN day IS NULL THEN 'undated' WHEN day < DATE '2000-01-01' THEN 'historical' ELSE 'recent' END AS queue FROM i)
"""


def work(spark, d):
    items = load(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 17 != 0, F.to_date("o_orderdate")).alias("day"),
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("pr"),
        F.when(F.col("o_orderstatus") != "F", F.date_format("o_orderdate", "yyyy-MM")).alias("att"))
    return items.withColumn("queue", queues.queue_name(F.col("day"), F.lit("2000-01-01").cast("date")))


@query("work_queue", QUEUE + """
, r AS (SELECT *, row_number() OVER (PARTITION BY queue ORDER BY CASE WHEN queue <> 'undated' THEN pr END, att, CASE WHEN queue <> 'undated' THEN day END DESC, id) AS queue_position,
  row_number() OVER (ORDER BY CASE queue WHEN 'recent' THEN 0 WHEN 'historical' THEN 1 ELSE 2 END, pr, att, day DESC, id) AS work_order FROM n),
f AS (SELECT *, NOT (queue = 'historical' AND queue_position > 500) AND NOT (queue = 'undated' AND queue_position > 300) AS fits FROM r)
SELECT id, queue, queue_position, work_order, fits AND sum(fits::INT) OVER (ORDER BY work_order) <= 4000 AS accepted FROM f
""")
def _(spark, d):
    done = queues.budget_work(work(spark, d), "queue", F.col("pr"), F.col("att"), F.col("day"), "id", 4000, {"historical": 500, "undated": 300})
    return done.select("id", "queue", "queue_position", "work_order", "accepted")


@query("queue_sizes", QUEUE + "SELECT queue, count(*) AS queue_size FROM n WHERE queue = 'undated' OR att <> '' GROUP BY 1")
def _(spark, d):
    return queues.queue_sizes(work(spark, d), F.col("queue"), F.col("att").isNotNull())


@query("byte_budget", """
WITH s AS (SELECT doc_id, lang, n_chars AS full_size, 10::BIGINT AS stub, doc_id % 9 = 0 AS prot FROM documents),
t AS (SELECT *, CASE WHEN prot THEN 0 ELSE full_size - stub END AS gain FROM s),
u AS (SELECT *, sum(gain) OVER (PARTITION BY lang ORDER BY doc_id) AS freed, sum(full_size) OVER (PARTITION BY lang) AS total, sum(gain) OVER (PARTITION BY lang) AS possible FROM t)
SELECT doc_id, lang, NOT prot AND freed - gain < total - 200000 AS reduced, possible >= total - 200000 AS fits FROM u
""")
def _(spark, d):
    docs = load(spark, d, "documents").select("doc_id", "lang", F.col("n_chars").alias("full_size"), F.lit(10).cast("long").alias("stub"))
    return queues.byte_budget(docs, ["lang"], "doc_id", "full_size", "stub", [F.col("doc_id")], F.col("doc_id") % 9 == 0, 200000).select(
        "doc_id", "lang", "reduced", "fits")


@query("recency_selection", """
WITH q AS (SELECT max(o_orderdate)::DATE AS t FROM orders)
SELECT o_orderkey, coalesce(o_orderkey % 13 <> 0 AND o_orderdate::DATE BETWEEN t - 14 AND t, false) OR o_orderkey % 13 = 0 OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem) AS should_check FROM orders, q
""")
def _(spark, d):
    orders = load(spark, d, "orders").withColumn("_one", F.lit(1))
    today = orders.groupBy("_one").agg(F.to_date(F.max("o_orderdate")).alias("today"))
    dated = orders.join(F.broadcast(today), "_one").select("o_orderkey", "today", F.when(F.col("o_orderkey") % 13 != 0, F.col("o_orderdate")).alias("day"))
    known = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return filters.recent_or_unknown(dated, "day", known, "o_orderkey", F.col("today")).select("o_orderkey", "should_check")


@query("pending_notices", """
SELECT o_orderkey, o_orderpriority = '1-URGENT' OR o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag <> 'R') AS pending FROM orders
""")
def _(spark, d):
    done = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.when(F.col("l_returnflag") != "R", "approved").otherwise("rejected").alias("document_status"))
    notices = load(spark, d, "orders").withColumn("status", F.when(F.col("o_orderpriority") == "1-URGENT", "fetch_failed").otherwise("incorporated"))
    return filters.pending_notice(notices, done, "status", "o_orderkey").select("o_orderkey", "pending")


@query("clean_preferences", """
SELECT event_id, array_to_string(list_distinct(list_filter([event_type, user_id::VARCHAR, event_type || '!', event_type], lambda x: regexp_full_match(x, '[a-z]+'))), ',') AS kept FROM events
""")
def _(spark, d):
    wanted = F.array("event_type", F.col("user_id").cast("string"), F.concat("event_type", F.lit("!")), F.col("event_type"))
    return load(spark, d, "events").select("event_id", F.array_join(filters.clean_preferences(wanted, "^[a-z]+$", 3000), ",").alias("kept"))


@query("coverage_gaps", """
SELECT CASE WHEN o_orderpriority IN ('4-NOT SPECIFIED', '5-LOW') THEN 'budget_deferred' WHEN o_orderpriority = '1-URGENT' THEN 'unavailable' ELSE 'pending_review' END AS gap, count(*) AS documents FROM orders GROUP BY 1
""")
def _(spark, d):
    priority = F.col("o_orderpriority")
    gap = F.when(priority.isin("4-NOT SPECIFIED", "5-LOW"), "budget_deferred").when(priority == "1-URGENT", "unavailable").otherwise("pending_review")
    return load(spark, d, "orders").groupBy(gap.alias("gap")).agg(F.count(F.lit(1)).alias("documents"))


@query("latest_events", """
SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 200
""")
def _(spark, d):
    return events(spark, d).orderBy(F.col("us").desc(), F.col("event_id").desc()).limit(200).select("event_id", "event_type")


@query("latest_notices_per_scope", """
WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate DESC, o_orderkey) AS position FROM orders)
SELECT o_orderpriority, o_orderkey, CAST(position AS INTEGER) AS position FROM r WHERE position <= 300
""")
def _(spark, d):
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return top_per_key(orders, ["o_orderpriority"], [F.col("o_orderdate").desc(), F.col("o_orderkey")], 300, spread=F.col("o_orderkey")).select(
        "o_orderpriority", "o_orderkey", "position")


@query("activity_windows", """
SELECT epoch_us(ts) // 1800000000 AS half_hour, count(*) AS checks, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1
""")
def _(spark, d):
    e = events(spark, d)
    return e.groupBy(F.window("at", "30 minutes").alias("w")).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(F.col("event_type") == "error").alias("failed")).select(
        F.floor(F.unix_micros("w.start") / 1_800_000_000).alias("half_hour"), "checks", "failed")


@query("state_edges_first_last", """
SELECT user_id, event_type AS parent, min(epoch_us(ts)) AS first_seen, max(epoch_us(ts)) AS last_seen FROM events GROUP BY 1, 2
""")
def _(spark, d):
    e = events(spark, d).withColumn("parent", F.col("event_type"))
    return inventory.merge_edges(e.where("value < 10"), e.where("NOT value < 10"), "user_id", "parent", "us")
