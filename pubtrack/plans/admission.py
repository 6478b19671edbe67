"""Queries over request admission, quotas, budgets, leases and probes, all on the event log."""

from __future__ import annotations

from pyspark.sql import functions as F

from pubtrack.operators import budgets, ledger
from pubtrack.plans.activity import by_time, events
from pubtrack.plans.registry import query

# Each second points to the next one that could be accepted; the walk follows the pointers.
WALK = """
p AS (SELECT t.*, u.s AS nxt, v.s AS later FROM t ASOF LEFT JOIN t u ON t.service = u.service AND t.s + {gap} <= u.s
 ASOF LEFT JOIN t v ON t.service = v.service AND greatest(t.s + {gap}, (t.s // 86400 + 1) * 86400) <= v.s),
a(service, s, n) AS (SELECT service, min(s), 1 FROM p GROUP BY 1 UNION ALL
 SELECT p.service, CASE WHEN a.n < {cap} THEN nxt ELSE later END, CASE WHEN (CASE WHEN a.n < {cap} THEN nxt ELSE later END) // 86400 = a.s // 86400 THEN a.n + 1 ELSE 1 END
 FROM a JOIN p ON p.service = a.service AND p.s = a.s WHERE (CASE WHEN a.n < {cap} THEN nxt ELSE later END) IS NOT NULL)
"""
THROTTLE = """
WITH RECURSIVE t AS (SELECT {service} AS service, epoch_us(ts) // 1000000 AS s, min(event_id) AS event_id FROM events GROUP BY 1, 2),
""" + WALK


@query("throttle_batch", THROTTLE.format(service="'gate'", gap=300, cap=96) + "SELECT t.service, t.s AS accepted_second, t.event_id FROM t JOIN a ON a.service = t.service AND a.s = t.s")
def _(spark, d):
    requests = events(spark, d).select(F.lit("gate").alias("service"), "event_id", "us")
    return ledger.throttle(requests, ["service"], "event_id", F.floor(F.col("us") / 1_000_000), 300, 96)


@query("throttle_attachments", THROTTLE.format(service="event_type", gap=1200, cap=96) + """
, k AS (SELECT t.service, t.event_id FROM t JOIN a ON a.service = t.service AND a.s = t.s)
SELECT e.event_id, k.event_id IS NOT NULL AS acquired, last_value(k.event_id IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY ts, e.event_id ROWS UNBOUNDED PRECEDING) AS job_id
FROM events e LEFT JOIN k ON k.service = e.event_type AND k.event_id = e.event_id
""")
def _(spark, d):
    requests = events(spark, d).select(F.col("event_type").alias("service"), "event_id", "us")
    accepted = ledger.throttle(requests, ["service"], "event_id", F.floor(F.col("us") / 1_000_000), 1200, 96)
    return ledger.with_acceptance(requests, accepted, ["service"], "event_id", by_time()).select("event_id", "acquired", "job_id")


@query("job_throttle", """
WITH RECURSIVE r AS (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, event_type = 'purchase' AS fin,
  row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts) // 1000000, event_type <> 'purchase', event_id) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase')),
w(user_id, n, event_id, fin, job, started, done, acquired) AS (SELECT user_id, n, event_id, fin, CASE WHEN NOT fin THEN event_id END, CASE WHEN NOT fin THEN s END, NULL::BIGINT, NOT fin FROM r WHERE n = 1
 UNION ALL SELECT user_id, n, event_id, fin, CASE WHEN ok THEN event_id ELSE job END, CASE WHEN ok THEN s ELSE started END, CASE WHEN ok THEN NULL WHEN fin AND started IS NOT NULL THEN coalesce(done, s) ELSE done END, ok
 FROM (SELECT r.*, w.job, w.started, w.done, NOT r.fin AND (w.started IS NULL OR CASE WHEN w.done IS NULL THEN r.s - w.started >= 900000 ELSE r.s - w.done >= 300000 END) AS ok
  FROM w JOIN r ON r.user_id = w.user_id AND r.n = w.n + 1))
SELECT user_id, event_id, acquired, job AS job_id FROM w WHERE NOT fin
""")
def _(spark, d):
    log = events(spark, d).select("user_id", "event_id", "event_type", F.floor(F.col("us") / 1_000_000).alias("second"))
    return ledger.job_throttle(log.where("event_type IN ('view', 'click')"), log.where("event_type = 'purchase'"), ["user_id"], "event_id", "second", 900_000, 300_000)


@query("write_admission", """
WITH RECURSIVE c AS (SELECT ts::DATE + 1 AS day, count(*) * 400 AS base FROM events WHERE event_type = 'error' GROUP BY 1),
r AS (SELECT event_id, ts::DATE AS day, CAST(trunc(value) AS BIGINT) * 32 + 8 AS reserved, coalesce(base, 0) AS base, row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS n
 FROM events LEFT JOIN c ON c.day = ts::DATE WHERE event_type IN ('purchase', 'signup')),
f(day, n, event_id, reserved, ok, used) AS (SELECT day, n, event_id, reserved, base + reserved <= 70000, base + CASE WHEN base + reserved <= 70000 THEN reserved ELSE 0 END FROM r WHERE n = 1
 UNION ALL SELECT r.day, r.n, r.event_id, r.reserved, f.used + r.reserved <= 70000, f.used + CASE WHEN f.used + r.reserved <= 70000 THEN r.reserved ELSE 0 END FROM f JOIN r ON r.day = f.day AND r.n = f.n + 1)
SELECT CAST(day AS DATE) AS day, event_id, reserved, CAST(used AS BIGINT) AS used FROM f WHERE ok
""")
def _(spark, d):
    e = events(spark, d).withColumn("day", F.to_date("ts"))
    wishes = e.where("event_type IN ('purchase', 'signup')").select("day", "us", "event_id", (F.col("value").cast("long") * 32 + 8).alias("reserved"))
    carried = e.where("event_type = 'error'").groupBy(F.date_add("day", 1).alias("day")).agg((F.count(F.lit(1)) * 400).alias("writes"))
    return ledger.write_admission(wishes, carried, "day", ["us", "event_id"], "event_id", "reserved", 70_000)


@query("lease_outcomes", """
WITH j AS (SELECT user_id AS job_id, epoch_us(min(ts)) AS started_us FROM events WHERE event_type = 'signup' GROUP BY 1),
c AS (SELECT j.job_id, min(epoch_us(e.ts)) AS f FROM j JOIN events e ON e.user_id = j.job_id AND e.event_type = 'purchase' AND epoch_us(e.ts) BETWEEN started_us AND started_us + 72000000000 GROUP BY 1)
SELECT j.job_id, started_us, CASE WHEN f IS NULL THEN 'failed' ELSE 'completed' END AS job_status, coalesce(f, started_us + 72000000000) AS ended_us FROM j LEFT JOIN c USING (job_id)
""")
def _(spark, d):
    e = events(spark, d).withColumn("job_id", F.col("user_id"))
    jobs = e.where("event_type = 'signup'").groupBy("job_id").agg(F.min("us").alias("started_us"))
    done = e.where("event_type = 'purchase'").select("job_id", F.col("us").alias("finished_us"))
    return ledger.lease_outcomes(jobs, done, "job_id", "started_us", "finished_us", 72000)


@query("client_quota", """
WITH r AS (SELECT event_id, event_type, ts::DATE AS day, row_number() OVER (PARTITION BY event_type, ts::DATE ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, event_type, CAST(n AS INTEGER) AS quota_position FROM r WHERE n <= 60
""")
def _(spark, d):
    requests = events(spark, d).select("event_id", "event_type", "us", F.to_date("ts").alias("day"))
    return ledger.client_quota(requests, ["event_type", "day"], by_time(), "event_id", 60).select("event_id", "event_type", "quota_position")


@query("quota_summary", """
SELECT left(sha256(concat_ws(':', ts::DATE, user_id)), 32) AS client, count(*) AS requests, least(count(*), 3) AS admitted, count(*) - least(count(*), 3) AS refused FROM events GROUP BY 1
""")
def _(spark, d):
    # The client is known only by a keyed hash that changes every day.
    client = F.left(F.sha2(F.concat_ws(":", F.to_date("ts").cast("string"), F.col("user_id").cast("string")), 256), F.lit(32))
    return ledger.quota_summary(events(spark, d).withColumn("client", client), ["client"], 3)


BUDGET = """
WITH RECURSIVE r AS (SELECT event_id, ts::DATE AS day, CAST(ceil(value / 5) AS BIGINT) * 100 AS estimate, CAST(trunc(value) AS BIGINT) * 20 AS actual,
  row_number() OVER (PARTITION BY ts::DATE ORDER BY ts, event_id) AS n, ts FROM events),
f(day, n, event_id, estimate, actual, ok, used, cnt) AS (SELECT day, n, event_id, estimate, actual, estimate <= 40000, CASE WHEN estimate <= 40000 THEN actual ELSE 0 END, CASE WHEN estimate <= 40000 THEN 1 ELSE 0 END FROM r WHERE n = 1
 UNION ALL SELECT r.day, r.n, r.event_id, r.estimate, r.actual, f.cnt < 150 AND f.used + r.estimate <= 40000,
  CASE WHEN f.cnt < 150 AND f.used + r.estimate <= 40000 THEN f.used + r.actual ELSE f.used END, CASE WHEN f.cnt < 150 AND f.used + r.estimate <= 40000 THEN f.cnt + 1 ELSE f.cnt END
  FROM f JOIN r ON r.day = f.day AND r.n = f.n + 1)
"""


def admitted(spark, d):
    requests = events(spark, d).select("event_id", "us", F.to_date("ts").alias("day"), (F.ceil(F.col("value") / 5) * 100).alias("estimate"),
                                       (F.col("value").cast("long") * 20).alias("actual"))
    return ledger.daily_budget(requests, "day", ["us", "event_id"], "event_id", "estimate", "actual", 40000, 150)


@query("daily_budget", BUDGET + "SELECT day, event_id, estimate, actual, CAST(used AS BIGINT) AS used FROM f WHERE ok")
def _(spark, d):
    return admitted(spark, d)


@query("settled_usage", BUDGET + """
, s AS (SELECT day, actual FROM f WHERE ok UNION ALL SELECT day + 1, actual FROM f WHERE ok AND event_id % 10 = 0)
SELECT CAST(day AS DATE) AS day, CAST(sum(actual) AS BIGINT) AS used, count(*) AS requests FROM s GROUP BY 1
""")
def _(spark, d):
    settled = admitted(spark, d).withColumn("settled_day", F.when(F.col("event_id") % 10 == 0, F.date_add("day", 1)).otherwise(F.col("day")))
    return ledger.settled_usage(settled, "day", "settled_day", "actual")


WRITES = """
WITH r AS (SELECT event_id AS reservation_id, ts::DATE AS day, CAST(trunc(value) AS BIGINT) + 8 AS reserved, epoch_us(ts) + 3600000000 AS expires_us, (ts + INTERVAL 1 HOUR)::DATE AS expires_day,
  CASE WHEN event_type <> 'error' THEN epoch_us(ts) + CAST(trunc(value) AS BIGINT) * 120000000 END AS settled_us, CASE WHEN event_id % 3 <> 0 THEN CAST(trunc(value) AS BIGINT) END AS written FROM events),
q AS (SELECT *, make_timestamp(settled_us)::DATE AS settled_day, settled_us >= expires_us AS expired, coalesce(written + 8, reserved) AS measured FROM r),
z AS (SELECT *, CASE WHEN expired THEN greatest(reserved, measured) ELSE measured END AS actual, CASE WHEN expired THEN expires_day ELSE settled_day END AS last_day FROM q),
al AS (SELECT reservation_id, day, CASE WHEN settled_us IS NULL THEN reserved ELSE actual END AS charged FROM z
 UNION ALL SELECT reservation_id, last_day, actual FROM z WHERE settled_us IS NOT NULL AND day < last_day UNION ALL SELECT reservation_id, settled_day, 8 FROM z WHERE settled_us IS NOT NULL AND settled_day > last_day)
"""


def write_ledger(spark, d):
    e = events(spark, d)
    whole = F.col("value").cast("long")
    to_day = lambda us: F.to_date(F.timestamp_micros(us))
    reservations = e.select(
        F.col("event_id").alias("reservation_id"), F.to_date("ts").alias("day"), (whole + 8).alias("reserved"), (F.col("us") + 3_600_000_000).alias("expires_us"),
        to_day(F.col("us") + 3_600_000_000).alias("expires_day"), (F.col("event_type") != "error").alias("settled"))
    settlements = e.where("event_type <> 'error'").select(
        F.col("event_id").alias("reservation_id"), (F.col("us") + whole * 120_000_000).alias("settled_us"), F.when(F.col("event_id") % 3 != 0, whole).alias("written"),
        to_day(F.col("us") + whole * 120_000_000).alias("settled_day"))
    return reservations, ledger.settle_writes(reservations.drop("settled"), settlements, 8)


@query("settled_writes", WRITES + "SELECT reservation_id, day, CAST(charged AS BIGINT) AS charged FROM al")
def _(spark, d):
    return write_ledger(spark, d)[1]


@query("write_usage", WRITES + """
, u AS (SELECT day, charged AS w FROM al UNION ALL SELECT expires_day, reserved FROM z WHERE settled_us IS NULL AND expires_day > day)
SELECT day, CAST(sum(w) AS BIGINT) AS writes FROM u GROUP BY 1
""")
def _(spark, d):
    reservations, allocations = write_ledger(spark, d)
    return ledger.write_usage(reservations.drop("expires_day"), reservations.select("reservation_id", "expires_day"), allocations)


@query("change_probe", """
WITH p AS (SELECT event_id, user_id, ts, CAST(trunc(value / 25) AS BIGINT) AS v, lag(CAST(trunc(value / 25) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b,
  (SELECT max(c.ts) FROM events c WHERE c.event_type = 'purchase' AND c.user_id = e.user_id AND c.ts <= e.ts) AS done FROM events e WHERE event_type IN ('view', 'click')),
i AS (SELECT *, last_value(CASE WHEN b IS NULL OR b <> v THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS st FROM p),
k AS (SELECT *, coalesce(done >= st, false) AS conf FROM i),
s AS (SELECT *, last_value(CASE WHEN conf OR b IS NULL THEN v END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stored FROM k)
SELECT event_id, CASE WHEN b IS NULL THEN 'baseline_recorded' WHEN stored = v THEN 'unchanged' WHEN conf THEN 'checked' ELSE 'changed_pending' END AS probe_status FROM s
""")
def _(spark, d):
    e = events(spark, d).select("event_id", "user_id", "us", "event_type", (F.col("value") / 25).cast("long").alias("validator"))
    return ledger.change_probe(e.where("event_type IN ('view', 'click')"), e.where("event_type = 'purchase'"), ["user_id"], "us", "event_id", "validator").select(
        "event_id", "probe_status")


@query("completion_correlation", """
SELECT r.user_id, r.created_us, min(epoch_us(c.ts)) AS completed_us FROM (SELECT user_id, epoch_us(max(ts)) - 86400000000 AS created_us FROM events GROUP BY 1) r
LEFT JOIN events c ON c.user_id = r.user_id AND c.event_type = 'purchase' AND epoch_us(c.ts) >= r.created_us - 1000000 GROUP BY 1, 2
""")
def _(spark, d):
    e = events(spark, d)
    requests = e.groupBy("user_id").agg((F.max("us") - 86_400_000_000).alias("created_us"))
    done = e.where("event_type = 'purchase'").select("user_id", F.col("us").alias("attempt_us"))
    return ledger.correlated_completions(requests, done, "user_id", "created_us", "attempt_us")


@query("watchdog_retries", """
WITH RECURSIVE o AS (SELECT user_id, event_id, ts, event_type, coalesce(lag(event_type IN ('error', 'signup')) OVER (PARTITION BY user_id ORDER BY ts, event_id), false) AS was FROM events),
t AS (SELECT user_id AS service, epoch_us(ts) // 1000000 AS s, min(event_id) AS event_id FROM o WHERE event_type IN ('error', 'signup') AND NOT (event_type = 'error' AND NOT was) GROUP BY 1, 2),
""" + WALK.format(gap=3600, cap=1000000) + """
SELECT t.service AS user_id, t.s AS accepted_second, t.event_id FROM t JOIN a ON a.service = t.service AND a.s = t.s
""")
def _(spark, d):
    seen = events(spark, d).select("user_id", "event_id", "us", "event_type")
    return ledger.watchdog_retries(seen, ["user_id"], "us", "event_id", F.col("event_type").isin("error", "signup"), F.col("event_type") == "error")


@query("expired_counters", """
WITH c AS (SELECT user_id, ts::DATE AS day, count(*) AS requests FROM events GROUP BY 1, 2) SELECT * FROM c WHERE day < DATE '2024-01-20' - 7
""")
def _(spark, d):
    counters = events(spark, d).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("requests"))
    return ledger.expired_counters(counters, "day", F.lit("2024-01-20").cast("date"))


@query("split_throttle", THROTTLE.format(service="'gate'", gap=300, cap=96) + "SELECT t.service, t.s AS accepted_second, t.event_id FROM t JOIN a ON a.service = t.service AND a.s = t.s")
def _(spark, d):
    requests = events(spark, d).select(F.lit("gate").alias("service"), "event_id", "us")
    return budgets.split_throttle(requests, ["service"], "event_id", F.floor(F.col("us") / 1_000_000), 300, 96)


# Requests and the later settlements of all of them in one log; a settlement counts if its request is still open.
DELAYED = """
WITH RECURSIVE q AS (SELECT event_type, event_id, epoch_us(ts) AS us, CAST(ceil(value / 5) AS BIGINT) * 100 AS estimate,
  CASE WHEN event_id % 7 <> 0 THEN epoch_us(ts) + CAST(trunc(value) AS BIGINT) * 120000000 END AS settled, CASE WHEN event_id % 5 <> 0 THEN CAST(trunc(value) AS BIGINT) * 20 END AS actual FROM events),
l AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY t, asks, event_id) AS n FROM (
  SELECT *, us AS t, true AS asks FROM q UNION ALL SELECT *, greatest(settled, us + 1), false FROM q WHERE settled IS NOT NULL)),
f(event_type, n, event_id, estimate, ok, day, used, cnt, held) AS (SELECT event_type, 0::BIGINT, NULL::BIGINT, 0::BIGINT, false, -1::BIGINT, 0::BIGINT, 0::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT event_type FROM q)
 UNION ALL SELECT event_type, n, event_id, estimate, asks AND fits, CASE WHEN fits OR counts THEN d ELSE day END,
  CASE WHEN asks AND fits THEN CASE WHEN d = day THEN used + estimate ELSE estimate END WHEN counts AND d = since THEN CASE WHEN day = since THEN greatest(0, used - estimate + charge) ELSE used END
   WHEN counts THEN CASE WHEN d = day THEN used + charge ELSE charge END ELSE used END,
  CASE WHEN asks AND fits THEN CASE WHEN d = day THEN cnt + 1 ELSE 1 END WHEN counts AND d <> since THEN CASE WHEN d = day THEN cnt + 1 ELSE 1 END ELSE cnt END,
  CASE WHEN asks AND fits AND settled IS NOT NULL THEN list_append(held, event_id) WHEN counts THEN list_filter(held, lambda x: x <> event_id) ELSE held END
 FROM (SELECT l.*, f.day, f.used, f.cnt, f.held, l.t // 86400000000 AS d, l.us // 86400000000 AS since, coalesce(l.actual + 32, l.estimate) AS charge,
   l.asks AND (l.t // 86400000000 <> f.day OR f.used + l.estimate <= 60000 AND f.cnt < 50) AS fits, NOT l.asks AND list_contains(f.held, l.event_id) AS counts
  FROM f JOIN l ON l.event_type = f.event_type AND l.n = f.n + 1))
SELECT event_type, event_id, day, estimate, used FROM f WHERE ok
"""


@query("delayed_budget", DELAYED)
def _(spark, d):
    whole = F.col("value").cast("long")
    requests = events(spark, d).select(
        "event_type", "event_id", "us", (F.ceil(F.col("value") / 5) * 100).alias("estimate"), F.when(F.col("event_id") % 7 != 0, F.col("us") + whole * 120_000_000).alias("settled"),
        F.when(F.col("event_id") % 5 != 0, whole * 20).alias("actual"))
    return budgets.delayed_budget(requests, ["event_type"], "event_id", "us", "estimate", "settled", "actual", 60_000, 50)


def write_ledger_sql(until):
    """SQL of the ledger over the log up to ``until``: state by state, with the open reservations as a list."""
    return f"""
WITH RECURSIVE l AS (SELECT *, tm // 86400000000 AS d, row_number() OVER (PARTITION BY user_id ORDER BY tm, wish IS NOT NULL, event_id) AS n FROM (
  SELECT user_id, event_id, epoch_us(ts) AS tm, CAST(trunc(value) AS BIGINT) + 8 AS wish, NULL::BIGINT AS written FROM events UNION ALL
  SELECT user_id, event_id, epoch_us(ts) + CAST(trunc(value) AS BIGINT) * 120000000, NULL, CASE WHEN event_id % 3 <> 0 THEN CAST(trunc(value) AS BIGINT) END FROM events WHERE event_id % 11 <> 0) WHERE tm < {until}),
f(user_id, n, event_id, day, charged, held, outcome, entries, used) AS (
 SELECT user_id, 0::BIGINT, NULL::BIGINT, -1::BIGINT, 0::BIGINT, []::STRUCT(i BIGINT, d BIGINT, r BIGINT, e BIGINT)[], '', []::STRUCT(d BIGINT, c BIGINT)[], 0::BIGINT FROM (SELECT DISTINCT user_id FROM events)
 UNION ALL SELECT user_id, n, event_id, d, charged2, held2, CASE WHEN wish IS NULL THEN 'charged' WHEN ok THEN 'admitted' ELSE 'refused' END, entries,
  charged2 + coalesce(list_sum(list_transform(list_filter(held2, lambda x: x.d < d AND d <= x.e // 86400000000), lambda x: x.r)), 0)::BIGINT FROM (
 SELECT *, CASE WHEN wish IS NOT NULL THEN CASE WHEN ok THEN charged1 + wish ELSE charged1 END WHEN z IS NULL THEN charged1
   ELSE charged1 + coalesce(list_sum(list_transform(list_filter(entries, lambda x: x.d = d), lambda x: x.c)), 0)::BIGINT - CASE WHEN z.d = d THEN z.r ELSE 0 END END AS charged2,
  CASE WHEN wish IS NOT NULL THEN CASE WHEN ok THEN list_append(held1, {{'i': event_id, 'd': d, 'r': wish, 'e': tm + 36000000000}}) ELSE held1 END ELSE list_filter(held1, lambda x: x.i <> event_id) END AS held2 FROM (
 SELECT *, CASE WHEN wish IS NOT NULL THEN [{{'d': d, 'c': wish}}] WHEN z IS NULL THEN [] ELSE list_concat([{{'d': z.d, 'c': actual}}], CASE WHEN z.d < edge THEN [{{'d': edge, 'c': actual}}] ELSE [] END,
   CASE WHEN d > edge THEN [{{'d': d, 'c': 8::BIGINT}}] ELSE [] END) END AS entries FROM (
 SELECT *, charged1 + carried1 + wish <= 100 AS ok, CASE WHEN tm >= z.e THEN greatest(z.r, coalesce(written + 8, z.r)) ELSE coalesce(written + 8, z.r) END AS actual,
  CASE WHEN tm >= z.e THEN z.e // 86400000000 ELSE d END AS edge FROM (
 SELECT *, coalesce(list_sum(list_transform(list_filter(held1, lambda x: x.d < d AND d <= x.e // 86400000000), lambda x: x.r)), 0)::BIGINT AS carried1,
  list_filter(held1, lambda x: x.i = event_id AND wish IS NULL)[1] AS z FROM (
 SELECT l.*, CASE WHEN l.d > f.day THEN 0 ELSE f.charged END AS charged1, CASE WHEN l.d > f.day THEN list_filter(f.held, lambda x: x.e // 86400000000 + 7 >= l.d) ELSE f.held END AS held1
 FROM f JOIN l ON l.user_id = f.user_id AND l.n = f.n + 1))))))
SELECT user_id, event_id, outcome, e.d AS day, e.c AS amount, used FROM (SELECT user_id, event_id, outcome, used, unnest(entries) AS e FROM f)
"""


def write_log(e):
    """Every event reserves; most settle later, some after the lease of ten hours or on another day, some never."""
    whole = F.col("value").cast("long")
    entries = F.array(F.struct(F.col("us").alias("at"), (whole + 8).alias("reserved"), F.lit(None).cast("long").alias("written")),
                      F.struct((F.col("us") + whole * 120_000_000).alias("at"), F.lit(None).cast("long").alias("reserved"), F.when(F.col("event_id") % 3 != 0, whole).alias("written")))
    entries = F.when(F.col("event_id") % 11 != 0, entries).otherwise(F.slice(entries, 1, 1))
    return e.select("user_id", "event_id", F.explode(entries).alias("l")).select("user_id", "event_id", "l.*")


@query("write_ledger", write_ledger_sql("4611686018427387904"))
def _(spark, d):
    return budgets.write_ledger(write_log(events(spark, d)), "user_id", "at", "event_id", "reserved", "written", 100, 36_000_000_000)
