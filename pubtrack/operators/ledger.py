"""Admission and budget logic over request logs (batch twins of the stream operators)."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubtrack.operators.queues import carry_state
from pubtrack.operators.scan import known_before, last_known, next_known, ordered_scan, top_per_key

DAY = 86_400


def throttle(requests: DataFrame, service: Sequence[str], identity: str, seconds: Column, gap: int, per_day: int) -> DataFrame:
    """Accepted requests of a single-flight service whose clock counts whole seconds.

    Only the first request of a second can be accepted, so requests are first reduced, map-side, to the
    first one of each second. Spark sorts these by service and second, and the walk keeps only the last
    acceptance and the count of the day, so quiet and busy services cost the same per second.
    """
    timed = requests.withColumn("accepted_second", seconds.cast("long"))
    first = timed.groupBy(*service, "accepted_second").agg(F.min(identity).alias(identity))
    names = list(service)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, free_at, day, used = None, 0, -1, 0
        for batch in batches:
            kept = []
            for *key, second in zip(*[batch[c].tolist() for c in [*names, "accepted_second"]]):
                if key != gate:
                    gate, free_at, day, used = key, second, -1, 0
                if second // DAY != day:
                    day, used = second // DAY, 0
                fits = second >= free_at and used < per_day
                kept.append(fits)
                if fits:
                    free_at, used = second + gap, used + 1
            yield batch[kept]

    ordered = first.repartition(*names).sortWithinPartitions(*names, "accepted_second")
    return ordered.mapInPandas(walk, ordered.schema)


def job_throttle(requests: DataFrame, finishes: DataFrame, service: Sequence[str], identity: str, seconds: str, lease: int, cooldown: int,
                 per_day: int = 1 << 31) -> DataFrame:
    """Every request with the job it starts or attaches to, where the gate follows the job: an open job blocks
    for its lease, a finished one for the cooldown since it finished, and a day starts at most ``per_day`` jobs.

    ``finishes`` (service, seconds) end the job that is open then; at one second they come first. The walk over
    the sorted log of a service holds one job.
    """
    names = list(service)
    log = requests.select(*names, seconds, identity).unionByName(finishes.select(*names, seconds, F.lit(None).cast(dict(requests.dtypes)[identity]).alias(identity)))
    ordered = log.repartition(*names).sortWithinPartitions(*names, seconds, F.col(identity).asc_nulls_first())
    types = dict(ordered.dtypes)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, job, start, done, day, used = None, None, None, None, -1, 0
        for batch in batches:
            batch = batch.astype({identity: "Int64"})
            rows = []
            for *key, second, request in zip(*[batch[c].tolist() for c in [*names, seconds, identity]]):
                if key != gate:
                    gate, job, start, done, day, used = key, None, None, None, -1, 0
                if request is pd.NA:
                    done = second if start is not None and done is None else done
                    continue
                if second // DAY != day:
                    day, used = second // DAY, 0
                free = start is None or (second - start >= lease if done is None else second - done >= cooldown)
                acquired = free and used < per_day
                if acquired:
                    job, start, done, used = request, second, None, used + 1
                rows.append((*key, request, acquired, job))
            yield pd.DataFrame(rows, columns=[*names, identity, "acquired", "job_id"]).astype({identity: "int64", "job_id": "Int64"})

    return ordered.mapInPandas(walk, ", ".join(f"{c} {types[c]}" for c in names) + f", {identity} {types[identity]}, acquired boolean, job_id {types[identity]}")


def with_acceptance(requests: DataFrame, accepted: DataFrame, service: Sequence[str], identity: str, order: Sequence[Column]) -> DataFrame:
    """Every request with the job it starts or attaches to: the latest acceptance so far."""
    marked = requests.join(accepted.select(*service, identity).withColumn("acquired", F.lit(True)), [*service, identity], "left")
    marked = marked.withColumn("acquired", F.coalesce("acquired", F.lit(False)))
    return ordered_scan(marked, service, order, [last_known("job_id", F.when(F.col("acquired"), F.col(identity)))])


def lease_outcomes(jobs: DataFrame, completions: DataFrame, job: str, started: str, finished: str, lease_seconds: int) -> DataFrame:
    """Terminal state of every job: the first completion within the lease, else failed at expiry."""
    expiry = F.col(started) + lease_seconds * 1_000_000
    within = completions.select(job, finished).join(jobs.select(job, started), job).where(F.col(finished).between(F.col(started), expiry))
    met = jobs.join(within.groupBy(job, started).agg(F.min(finished).alias("_first")), [job, started], "left")
    return met.select(job, started, F.when(F.col("_first").isNotNull(), "completed").otherwise("failed").alias("job_status"),
                      F.coalesce("_first", expiry).alias("ended_us"))


def client_quota(requests: DataFrame, client: Sequence[str], order: Sequence[Column], identity: str, most: int = 120) -> DataFrame:
    """Requests inside the daily quota of a client; the limit is applied before the shuffle."""
    return top_per_key(requests, client, order, most, spread=F.col(identity), name="quota_position")


def quota_summary(requests: DataFrame, client: Sequence[str], most: int = 120) -> DataFrame:
    """Admitted and refused requests per client and day."""
    counted = requests.groupBy(*client).agg(F.count(F.lit(1)).alias("requests"))
    return counted.withColumn("admitted", F.least("requests", F.lit(most))).withColumn(
        "refused", F.col("requests") - F.least("requests", F.lit(most)))


def daily_budget(requests: DataFrame, day: str, order: Sequence[str], identity: str, estimate: str, actual: str, budget: int,
                 most: int = 2000) -> DataFrame:
    """Requests admitted under a shared daily budget: used + estimate must fit and fewer than
    ``most`` requests be admitted so far. Refused requests use nothing; admitted ones settle at once
    to their actual cost.

    Usage never falls, so once an estimate is refused all later equal ones of the day are refused:
    the admitted requests of one estimate are its first ones, at most ``most``. Cutting every
    (day, estimate) to its first ``most`` requests is therefore exact, happens before the shuffle,
    and bounds what one day can hold however many requests it had.
    """
    columns = [F.col(c) for c in order]
    possible = requests.where(F.col(estimate) <= budget).select(day, *dict.fromkeys([*order, identity]), estimate, actual)
    bounded = top_per_key(possible, [day, estimate], columns, most, spread=F.col(identity))
    return _walk_days(bounded.withColumn("_base", F.lit(0).cast("long")), day, order, identity, estimate, actual, budget, most)


def _walk_days(requests: DataFrame, day: str, order: Sequence[str], identity: str, estimate: str, actual: str, budget: int, most: int) -> DataFrame:
    """Walk the requests of every day in order. Days are sorted by Spark, and the walk holds the running
    usage of one day (starting at its ``_base``) and the count, never its rows."""
    types = dict(requests.dtypes)
    names = [day, identity, estimate, actual]

    def admit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        today, used, count = None, 0, 0
        for batch in batches:
            kept, after = [], []
            for at, wish, cost, base in zip(batch[day].tolist(), batch[estimate].tolist(), batch[actual].tolist(), batch["_base"].tolist()):
                if at != today:
                    today, used, count = at, int(base), 0
                fits = count < most and used + wish <= budget
                kept.append(fits)
                if fits:
                    used, count = used + int(cost), count + 1
                after.append(used)
            yield batch.assign(used=after)[kept][[*names, "used"]]

    ordered = requests.repartition(day).sortWithinPartitions(day, *order)
    return ordered.mapInPandas(admit, ", ".join(f"{c} {types[c]}" for c in names) + ", used long")


def write_admission(wishes: DataFrame, carried: DataFrame, day: str, order: Sequence[str], identity: str, reserved: str, limit: int) -> DataFrame:
    """Reservations admitted under the daily write limit: charged + carried over + wish must fit.

    ``carried`` (day, writes) is what open reservations of earlier days still count on a day (see
    :func:`write_usage`). An admitted reservation is charged at once with what it reserves; ``used`` is the
    usage after it. Wishes are only dropped where they alone exceed what the day has left at its start.
    """
    base = carried.groupBy(day).agg(F.sum("writes").cast("long").alias("_base"))
    met = wishes.select(*dict.fromkeys([day, *order, identity, reserved])).join(base, day, "left").withColumn("_base", F.coalesce("_base", F.lit(0).cast("long")))
    possible = met.where(F.col("_base") + F.col(reserved) <= limit).withColumn("_cost", F.col(reserved))
    return _walk_days(possible, day, order, identity, reserved, "_cost", limit, 1 << 62).drop("_cost")


def settled_usage(admitted: DataFrame, day: str, settled_day: str, actual: str) -> DataFrame:
    """Charged cost per day; a request that ends after midnight is charged to both days."""
    same = admitted.select(F.col(day).alias("day"), F.col(actual).alias("_c"))
    crossed = admitted.where(F.col(settled_day) != F.col(day)).select(F.col(settled_day).alias("day"), F.col(actual).alias("_c"))
    return same.unionByName(crossed).groupBy("day").agg(F.sum("_c").alias("used"), F.count(F.lit(1)).alias("requests"))


def write_usage(reservations: DataFrame, leases: DataFrame, allocations: DataFrame) -> DataFrame:
    """Writes counted per day: charges of that day plus open reservations of earlier days whose
    lease reaches into it and that were not charged there. Leases last minutes to an hour, so a
    reservation reaches very few days."""
    charged = allocations.select("day", F.col("charged").alias("writes"))
    opened = reservations.where(~F.col("settled")).join(leases, "reservation_id")
    reach = opened.where(F.col("expires_day") > F.col("day")).select(
        "reservation_id", "reserved", F.explode(F.sequence(F.date_add("day", 1), F.col("expires_day"))).alias("day"))
    carried = reach.join(allocations.select("reservation_id", "day"), ["reservation_id", "day"], "left_anti").select(
        "day", F.col("reserved").alias("writes"))
    return charged.unionByName(carried).groupBy("day").agg(F.sum("writes").alias("writes"))


def settle_writes(reservations: DataFrame, settlements: DataFrame, overhead: int) -> DataFrame:
    """Allocations after settlement. In time: the measured cost; expired: at least what was
    reserved; crossing midnight: both days; settled after the lease day: the overhead on top."""
    met = reservations.join(settlements, "reservation_id", "left")
    measured = F.coalesce(F.col("written") + overhead, F.col("reserved"))
    expired = F.col("settled_us") >= F.col("expires_us")
    actual = F.when(expired, F.greatest("reserved", measured)).otherwise(measured)
    last_day = F.when(expired, F.col("expires_day")).otherwise(F.col("settled_day"))
    entries = F.when(F.col("settled_us").isNull(), F.array(F.struct(F.col("day").alias("day"), F.col("reserved").alias("charged")))).otherwise(
        F.array_compact(F.array(
            F.struct(F.col("day").alias("day"), actual.alias("charged")),
            F.when(F.col("day") < last_day, F.struct(last_day.alias("day"), actual.alias("charged"))),
            F.when(F.col("settled_day") > last_day, F.struct(F.col("settled_day").alias("day"), F.lit(overhead).cast("long").alias("charged"))))))
    return met.select("reservation_id", F.explode(entries).alias("e")).select("reservation_id", "e.day", "e.charged")


def change_probe(probes: DataFrame, completions: DataFrame, source: Sequence[str], at: str, identity: str, validator: str) -> DataFrame:
    """State of every probe of a source: ``baseline_recorded``, ``unchanged``, ``changed_pending`` or
    ``checked``.

    A changed validator stays pending until a completion that is not older than its first
    observation; only then it becomes the stored one. Stored is the validator of the latest run of
    equal validators that was confirmed, so the whole state follows from ordered scans.
    """
    union = probes.select(*source, at, identity, validator, F.lit(1).alias("_kind")).unionByName(
        completions.select(*source, at, identity).withColumn("_kind", F.lit(0)), allowMissingColumns=True)
    order = [F.col(at), F.col("_kind"), F.col(identity)]
    probe = F.col("_kind") == 1
    seen = ordered_scan(union, source, order, [last_known("_done", F.when(~probe, F.col(at))),
                                               known_before("_before", F.when(probe, F.struct(F.col(validator).alias("v"))))], keep=True).where(probe)
    first = F.col("_before.v").isNull()
    starts = first | (F.col("_before.v") != F.col(validator))
    runs = ordered_scan(seen.withColumn("_first", first), source, order, [last_known("_start", F.when(starts, F.col(at)))], keep=True)
    confirmed = F.coalesce(F.col("_done") >= F.col("_start"), F.lit(False))
    marked = runs.withColumn("_confirmed", confirmed)
    stored = ordered_scan(marked, source, order, [known_before("_stored", F.when(F.col("_confirmed") | F.col("_first"), F.col(validator)))])
    status = (F.when(F.col("_first"), "baseline_recorded").when(F.col("_stored") == F.col(validator), "unchanged")
              .when(F.col("_confirmed"), "checked").otherwise("changed_pending"))
    return stored.select(*source, at, identity, validator, status.alias("probe_status"))


def correlated_completions(requests: DataFrame, completions: DataFrame, request: str, created: str, attempt: str) -> DataFrame:
    """Earliest completion of each request that is not older than one second before it."""
    # One scan over both tables finds the nearest completion; nothing is paired.
    union = requests.withColumn("_t", F.col(created) - 1_000_000).withColumn("_kind", F.lit(0)).unionByName(
        completions.select(request, F.col(attempt).alias("_t"), F.lit(1).alias("_kind")), allowMissingColumns=True)
    scanned = ordered_scan(union, [request], [F.col("_t"), F.col("_kind")], [
        next_known("completed_us", F.when(F.col("_kind") == 1, F.col("_t")))])
    return scanned.where("_kind = 0").select(*requests.columns, "completed_us")


def watchdog_retries(observations: DataFrame, service: Sequence[str], at: str, identity: str, needs: Column, unavailable: Column,
                     wait_seconds: int = 3600) -> DataFrame:
    """Observations that start a recovery: a refresh is needed, a first unavailability waits for a
    second observation, and attempts are at least ``wait_seconds`` apart."""
    carried = carry_state(observations, service, [F.col(at), F.col(identity)], needs, at)
    transient = unavailable & (F.col("first_failure") == F.col(at))
    eligible = carried.where(needs & ~transient)
    return throttle(eligible, service, identity, F.floor(F.col(at) / 1_000_000), wait_seconds, 1 << 30)


def expired_counters(counters: DataFrame, day: str, today: Column, days: int = 7) -> DataFrame:
    """Counters older than the retention."""
    return counters.where(F.col(day) < F.date_sub(today, days))

