"""Run logs, health, correlation and status roll-ups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubtrack.functions.values import closed
from pubtrack.operators.scan import ordered_scan, previous

# Closed vocabularies of run logs.
RUN_STATUSES = ["running", "success", "failed", "partial", "pending_budget", "skipped"]
ISSUES_NOT_ACTIONABLE = ["coverage_partial", "recovery_unavailable"]


def closed_counts(rows: DataFrame, value: Column, allowed: Sequence[str], other: str, name: str = "status") -> DataFrame:
    """Counts per closed vocabulary; unknown values fall into ``other``."""
    return rows.groupBy(closed(value, allowed, other).alias(name)).agg(F.count(F.lit(1)).alias("record_count"))


def status_matrix(rows: DataFrame, phase: str, status: str, phases: Sequence[str], statuses: Sequence[str]) -> DataFrame:
    """Count of every phase and status of the closed lists, zeros included."""
    counts = rows.groupBy(phase, status).agg(F.count(F.lit(1)).alias("_n"))
    spark = rows.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*[F.lit(p) for p in phases])).alias(phase)).select(
        phase, F.explode(F.array(*[F.lit(s) for s in statuses])).alias(status))
    return grid.join(counts, [phase, status], "left").select(phase, status, F.coalesce("_n", F.lit(0).cast("long")).alias("run_count"))


def interval_medians(runs: DataFrame, scope: Sequence[str], started: Column, order: Sequence[Column]) -> DataFrame:
    """Exact median of the seconds between successive runs. Equal gaps are counted before the
    median is taken, so the grouped data is one row per distinct gap."""
    timed = runs.withColumn("_at", started)
    gaps = ordered_scan(timed, scope, order, [previous("_before", F.col("_at"))])
    gaps = gaps.where(F.col("_before").isNotNull()).withColumn("gap", F.col("_at") - F.col("_before"))
    return exact_median(gaps, scope, "gap", "median_interval")


def exact_median(rows: DataFrame, scope: Sequence[str], value: str, name: str) -> DataFrame:
    """Median that averages the middle pair, by ordered positions over distinct values: no
    group is held in memory and a hot group is spread over many tasks."""
    from pubtrack.operators.scan import total

    counted = rows.groupBy(*scope, value).agg(F.count(F.lit(1)).alias("_n"))
    placed = ordered_scan(counted, scope, [F.col(value)], [total("_upto", F.col("_n"))])
    sizes = counted.groupBy(*scope).agg(F.sum("_n").alias("_size"))
    met = placed.join(sizes, list(scope))
    low, high = F.floor((F.col("_size") + 1) / 2), F.floor(F.col("_size") / 2) + 1
    start = F.col("_upto") - F.col("_n")
    left = F.when((low > start) & (low <= F.col("_upto")), F.col(value))
    right = F.when((high > start) & (high <= F.col("_upto")), F.col(value))
    return met.groupBy(*scope).agg(((F.max(left) + F.max(right)) / 2).cast("double").alias(name))


def trial_progress(runs: DataFrame, scope: Sequence[str], epoch_seconds: Column) -> DataFrame:
    """Nominal half-hour windows of a 14-day trial and its state."""
    span = runs.groupBy(*scope).agg(F.min(epoch_seconds).alias("_a"), F.max(epoch_seconds).alias("_b"))
    elapsed = F.col("_b") - F.col("_a")
    return span.select(*scope, F.least(F.lit(672), F.floor(elapsed / 1800)).cast("long").alias("elapsed_windows"),
                       F.when(elapsed >= 14 * 86400, "evaluation_pending").otherwise("collecting").alias("trial_status"))


def run_outcomes(phases: DataFrame, run: Sequence[str], status: str, bad: Sequence[str]) -> DataFrame:
    """Any bad phase fails the run; all successful make it a success; otherwise partial."""
    return phases.groupBy(*run).agg(
        F.when(F.bool_or(F.col(status).isin(list(bad))), "failed")
        .when(F.bool_and(F.col(status) == "success"), "success").otherwise("partial").alias("outcome"))


def operational_failure(checks: DataFrame, run: Sequence[str], success: Column, error: Column, tolerated: Sequence[str],
                        tolerated_missing: Column) -> DataFrame:
    """Whether a run failed for a reason other than tolerated ones."""
    hard = ~success & ~F.coalesce(error.isin(list(tolerated)), F.lit(False)) & ~F.coalesce(tolerated_missing, F.lit(False))
    return checks.groupBy(*run).agg(F.bool_or(hard).alias("operational_failure"), F.bool_and(success).alias("complete"))


def correlate_attempts(attempts: DataFrame, runs: DataFrame, request: str, at: str, slack_seconds: int = 1,
                       bucket_seconds: int = 3600) -> DataFrame:
    """Attempts with the run of the same request whose interval, widened by the slack, holds them.

    Runs are laid out over the time buckets they cover and joined by (request, bucket), so a request
    id with very many attempts and runs is not paired with itself as a whole.
    """
    slack = F.make_dt_interval(secs=F.lit(slack_seconds).cast("decimal(18,6)"))

    def bucket(stamp: Column) -> Column:
        return F.floor(F.unix_seconds(stamp.cast("timestamp")) / bucket_seconds)

    spans = runs.where(F.col("started_at") <= F.col("ended_at")).select(
        F.col(request).alias("_request"), "run_id", (F.col("started_at") - slack).alias("_from"), (F.col("ended_at") + slack).alias("_to"))
    spans = spans.withColumn("_bucket", F.explode(F.sequence(bucket(F.col("_from")), bucket(F.col("_to")))))
    placed = attempts.withColumn("_at_bucket", bucket(F.col(at)))
    inside = ((F.col(request) == F.col("_request")) & (F.col("_at_bucket") == F.col("_bucket"))
              & (F.col(at) >= F.col("_from")) & (F.col(at) <= F.col("_to")))
    return placed.join(spans, inside, "left").drop("_request", "_bucket", "_at_bucket", "_from", "_to")


def consistency(left: DataFrame, middle: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Three published copies agree on id, count and instant; each has ``version``, ``records``, ``checked``."""
    def named(table: DataFrame, tag: str) -> DataFrame:
        return table.select(*key, *[F.col(c).alias(f"{tag}_{c}") for c in ("version", "records", "checked")])

    met = named(left, "a").join(named(middle, "b"), list(key), "full").join(named(right, "c"), list(key), "full")
    same = F.lit(True)
    for column in ("version", "records", "checked"):
        same = same & F.col(f"a_{column}").eqNullSafe(F.col(f"b_{column}")) & F.col(f"b_{column}").eqNullSafe(F.col(f"c_{column}"))
        same = same & F.col(f"a_{column}").isNotNull()
    return met.select(*key, same.alias("consistent"))


def assess_health(health: DataFrame, now: Column) -> DataFrame:
    """Issues, the actionable ones and the state of every health report.

    Expects ``published_at``, ``checked_at``, ``active_checked_at`` (instants), ``active_version``,
    ``version_id``, ``record_count``, ``row_count``, ``origin_check_complete``, ``position_status``,
    ``run_status``, ``vacancy_status``, ``coverage_complete``, ``pending_documents``,
    ``unavailable_documents``, ``cache_status``, ``recovery_status``.
    """
    def minutes(column: str) -> Column:
        return (F.unix_micros(now) - F.unix_micros(F.col(column))) / 60_000_000

    def valid(column: str) -> Column:
        return F.coalesce(minutes(column) >= -1, F.lit(False))

    def yes(rule: Column) -> Column:
        return F.coalesce(rule, F.lit(False))

    absent = F.col("version_id").isNull()
    mismatch = (absent | ~F.col("active_version").eqNullSafe(F.col("version_id"))
                | ~F.col("record_count").eqNullSafe(F.col("row_count"))
                | ~yes(F.col("checked_at") == F.col("active_checked_at")))
    issues = {
        "publication_stale": minutes("published_at") > 90,
        "position_stale": absent | ~valid("checked_at") | yes(minutes("checked_at") > 90),
        "origin_unverified": ~(yes(F.col("origin_check_complete")) & yes(F.col("position_status") == "verified")),
        "publication_mismatch": mismatch,
        "collection_failed": yes(F.col("run_status") == "failed") | yes(F.col("vacancy_status") == "failed"),
        "coverage_partial": ~yes(F.col("coverage_complete")) | yes(F.col("pending_documents") > 0)
        | yes(F.col("unavailable_documents") > 0) | yes(F.col("vacancy_status") == "partial"),
        "recovery_unavailable": ~(yes(F.col("cache_status") == "ready") & yes(F.col("recovery_status") == "verified")),
    }
    found = F.array_compact(F.array(*[F.when(rule, F.lit(label)) for label, rule in issues.items()]))
    rated = health.withColumn("issues", F.when(valid("published_at"), found).otherwise(F.array(F.lit("publication_unavailable"))))
    ignored = F.array(*[F.lit(i) for i in ISSUES_NOT_ACTIONABLE])
    grace = F.when(yes(minutes("published_at") <= 20), F.array(F.lit("publication_mismatch"))).otherwise(F.array().cast("array<string>"))
    actionable = F.array_except(F.array_except("issues", ignored), grace)
    unavailable = F.array_contains("issues", "publication_unavailable")
    return rated.withColumn("needs_refresh", F.size(actionable) > 0).withColumn(
        "health", F.when(unavailable, "unavailable").when(F.size(actionable) > 0, "degraded")
        .when(F.size("issues") > 0, "partial").otherwise("healthy"))


def receipts(received: DataFrame, key: Sequence[str], at: str, tie: str, carried: Sequence[str]) -> DataFrame:
    """One receipt per key: first arrival, number of attempts, the rest from the latest."""
    order = F.struct(at, tie)
    return received.groupBy(*key).agg(
        F.min(at).alias("received_at"), F.max(at).alias("last_received_at"), F.count(F.lit(1)).alias("attempts"),
        *[F.max_by(c, order).alias(c) for c in carried])


def merge_receipts(stored: DataFrame, received: DataFrame, key: Sequence[str], carried: Sequence[str]) -> DataFrame:
    """Upsert of aggregated receipts: first arrival kept, attempts added, newest fields win."""
    both = stored.unionByName(received)
    return both.groupBy(*key).agg(
        F.min("received_at").alias("received_at"), F.max("last_received_at").alias("last_received_at"),
        F.sum("attempts").alias("attempts"), *[F.max_by(c, "last_received_at").alias(c) for c in carried])


def run_ledger(events: DataFrame, known: DataFrame, run: str, at: str, is_start: Column, is_end: Column) -> DataFrame:
    """New runs with first start, last end and elapsed seconds; known runs are not inserted again."""
    fresh = events.join(known.select(run).distinct(), run, "left_anti")
    spans = fresh.groupBy(run).agg(F.min(F.when(is_start, F.col(at))).alias("started_at"), F.max(F.when(is_end, F.col(at))).alias("ended_at"))
    ended = F.when(F.col("ended_at") >= F.col("started_at"), F.col("ended_at"))
    return spans.where(F.col("started_at").isNotNull()).withColumn("ended_at", ended).withColumn(
        "elapsed_seconds", (F.unix_micros(F.col("ended_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1_000_000)


def forward_only(stored: DataFrame, updates: DataFrame, key: Sequence[str], stamp: str) -> DataFrame:
    """Upsert that only moves a time stamp forward; unknown counts as oldest."""
    latest = stored.select(*key, stamp).unionByName(updates.select(*key, stamp))
    return latest.groupBy(*key).agg(F.max(stamp).alias(stamp))
