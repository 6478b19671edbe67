"""Keyed state machines and event-time operators on Structured Streaming.

State functions see one key's rows of a micro-batch as Arrow batches. Throttle, quota, budget and
lease reduce every batch on arrival (to one row per second, or to the few rows that can still
matter), so a busy key does not have to fit in memory. Probe and watchdog need every observation in
order; what they hold of one key is bounded by the micro-batch, hence by ``files_per_trigger``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

DAY = 86_400
MICROS = 1_000_000


def _types(table: DataFrame, columns: Sequence[str]) -> str:
    types = dict(table.dtypes)
    return ", ".join(f"{c} {types[c]}" for c in columns)


def first_of_seconds(requests: DataFrame, service: str, identity: str, epoch_us: str) -> DataFrame:
    """The least identity of every service and second of a micro-batch, at the start of the second. Seconds are dealt over all
    tasks, and one row of each goes on: what a busy service has to sort grows with the seconds, not with the requests."""
    names = [service, identity, epoch_us]

    def firsts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            both = batch if held is None else pd.concat([held, batch])
            held = both.groupby([service, epoch_us], as_index=False, dropna=False).min()
        if held is not None:
            yield held[names]

    second = F.col(epoch_us) - F.pmod(F.col(epoch_us), F.lit(MICROS))
    return requests.where(F.col(epoch_us).isNotNull()).select(service, identity, second.cast("long").alias(epoch_us)).repartition(
        service, epoch_us).mapInPandas(firsts, _types(requests, [service, identity]) + f", {epoch_us} long")


def throttle_stream(requests: DataFrame, service: str, identity: str, epoch_us: str, gap: int, per_day: int) -> DataFrame:
    """Accepted requests of a single-flight service: at least ``gap`` seconds apart and at most
    ``per_day`` per UTC day, on a clock of whole seconds. A request of a day before the newest one seen
    comes too late to be judged; the first of its second is listed with the outcome ``late``."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        free_at, day, used = state.get if state.exists else (0, -1, 0)
        ticks = pd.DataFrame({"second": pd.Series(dtype="int64"), identity: pd.Series(dtype="int64")})
        for batch in batches:
            batch = pd.DataFrame({"second": batch[epoch_us] // MICROS, identity: batch[identity]})
            ticks = pd.concat([ticks, batch]).groupby("second", as_index=False).min()
        kept = []
        for second, request in zip(ticks["second"], ticks[identity]):
            today = int(second) // DAY
            if today > day:
                day, used = today, 0
            if today < day:
                kept.append((key[0], int(request), int(second), "late"))
            elif second >= free_at and used < per_day:
                kept.append((key[0], int(request), int(second), "accepted"))
                free_at, used = int(second) + gap, used + 1
        state.update((free_at, day, used))
        if kept:
            yield pd.DataFrame(kept, columns=[service, identity, "accepted_second", "outcome"])

    return first_of_seconds(requests, service, identity, epoch_us).groupBy(service).applyInPandasWithState(
        step, f"{_types(requests, [service, identity])}, accepted_second long, outcome string", "free_at long, day long, used int", "append",
        GroupStateTimeout.NoTimeout)


def quota_stream(requests: DataFrame, client: str, day: str, at: str, identity: str, most: int, keep: str = "7 days") -> DataFrame:
    """Requests inside the daily quota of a client. The counter of a day is dropped once the
    watermark has passed it by the retention."""
    keep_ms = int(pd.Timedelta(keep).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        used = state.get[0] if state.exists else 0
        room = most - used
        first = None
        for batch in batches:
            first = batch if first is None else pd.concat([first, batch])
            first = first.sort_values([at, identity]).head(max(room, 0))
        admitted = first.head(max(room, 0))
        state.update((used + len(admitted),))
        end = int(pd.Timestamp(key[1]).timestamp() * 1000) + DAY * 1000 + keep_ms
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        if len(admitted):
            yield admitted.assign(quota_position=range(used + 1, used + len(admitted) + 1))[[client, day, identity, "quota_position"]]

    return requests.select(client, day, at, identity).groupBy(client, day).applyInPandasWithState(
        step, f"{_types(requests, [client, day, identity])}, quota_position long", "used long", "append", GroupStateTimeout.EventTimeTimeout)


def budget_stream(requests: DataFrame, day: str, order: Sequence[str], identity: str, estimate: str, actual: str, budget: int, most: int) -> DataFrame:
    """Requests admitted under a shared daily budget; admitted ones settle to their actual cost."""
    names = list(order)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used, count = state.get if state.exists else (0, 0)
        rows = None
        for batch in batches:
            rows = batch if rows is None else pd.concat([rows, batch])
            # Only the first requests of each estimate can be admitted (usage never falls).
            rows = rows.sort_values(names).groupby(estimate, sort=False).head(max(most - count, 0))
        rows = rows.sort_values(names)
        kept = []
        for wish, cost, request in zip(rows[estimate], rows[actual], rows[identity]):
            if count < most and used + wish <= budget:
                used, count = used + int(cost), count + 1
                kept.append((key[0], request, int(wish), int(cost), used))
        state.update((used, count))
        if kept:
            yield pd.DataFrame(kept, columns=[day, identity, estimate, actual, "used"])

    wanted = list(dict.fromkeys([day, *names, identity, estimate, actual]))
    # What can never fit does not reach the day's group.
    return requests.where(F.col(estimate) <= budget).select(*wanted).groupBy(day).applyInPandasWithState(
        step, f"{_types(requests, [day, identity, estimate, actual])}, used long", "used long, requests int", "append", GroupStateTimeout.NoTimeout)


def lease_stream(log: DataFrame, job: str, epoch_us: str, is_start: str, lease_seconds: int, keep: str = "7 days") -> DataFrame:
    """Terminal state per job from a log of starts and completions (one watermarked stream): completed
    within the lease, or failed when event time passes its end. The first completion that is not before
    the start counts, in whatever order the rows arrive; completions that come before their start are kept
    for the retention. Ended jobs are forgotten after the retention; until then a job ends only once."""
    lease_us, keep_us = lease_seconds * MICROS, int(pd.Timedelta(keep).total_seconds() * MICROS)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, finished, waiting = state.get if state.exists else (None, None, "")
        if state.hasTimedOut:
            if finished is not None or started is None:
                state.remove()
                return
            state.update((started, started + lease_us, ""))
            state.setTimeoutTimestamp(max((started + lease_us + keep_us) // 1000, state.getCurrentWatermarkMs() + 1))
            yield pd.DataFrame({job: [key[0]], "started_us": [started], "job_status": ["failed"], "ended_us": [started + lease_us]})
            return
        ends = {int(x) for x in waiting.split(",") if x}
        for batch in batches:
            starts = batch.loc[batch[is_start], epoch_us]
            if len(starts) and finished is None:
                started = int(starts.min()) if started is None else min(started, int(starts.min()))
            ends.update(int(x) for x in batch.loc[~batch[is_start], epoch_us])
        if started is not None:
            # Only the first completion from the start onwards can still matter.
            ends = set(sorted(x for x in ends if x >= started)[:1])
        completed = finished is None and started is not None and bool(ends) and min(ends) <= started + lease_us
        if completed:
            finished = min(ends)
        state.update((started, finished, "" if finished is not None else ",".join(map(str, sorted(ends)))))
        wake = (max(ends) + keep_us) if started is None else started + lease_us + (0 if finished is None else keep_us)
        state.setTimeoutTimestamp(max(wake // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if completed:
            yield pd.DataFrame({job: [key[0]], "started_us": [started], "job_status": ["completed"], "ended_us": [finished]})

    return log.groupBy(job).applyInPandasWithState(
        step, f"{_types(log, [job])}, started_us long, job_status string, ended_us long", "started long, finished long, waiting string", "append",
        GroupStateTimeout.EventTimeTimeout)


def probe_stream(log: DataFrame, source: str, epoch_us: str, identity: str, validator: str, is_probe: str) -> DataFrame:
    """State of every probe of a source: baseline, unchanged, changed and pending, or checked after a
    completion that is not older than the first observation of the change."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        stored, pending, since, done = state.get if state.exists else (None, None, None, None)
        rows = pd.concat(list(batches)).sort_values([epoch_us, is_probe, identity])
        out = []
        for at, number, value, probe in zip(rows[epoch_us], rows[identity], rows[validator], rows[is_probe]):
            at = int(at)
            if not probe:
                done = at
                continue
            value = int(value)
            if pending != value:
                pending, since = value, at
            confirmed = done is not None and done >= since
            if stored is None:
                status, stored = "baseline_recorded", value
            elif stored == value:
                status = "unchanged"
            elif confirmed:
                status, stored = "checked", value
            else:
                status = "changed_pending"
            out.append((key[0], int(number), status))
        state.update((stored, pending, since, done))
        if out:
            yield pd.DataFrame(out, columns=[source, identity, "probe_status"])

    return log.groupBy(source).applyInPandasWithState(
        step, f"{_types(log, [source, identity])}, probe_status string", "stored long, pending long, since long, done long", "append",
        GroupStateTimeout.NoTimeout)


def watchdog_stream(log: DataFrame, service: str, epoch_us: str, identity: str, needs: str, unavailable: str, wait_seconds: int = 3600) -> DataFrame:
    """Observations that start a recovery: needed, not the first unavailability, and at least
    ``wait_seconds`` after the one before."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        failing, free_at = state.get if state.exists else (False, 0)
        rows = pd.concat(list(batches)).sort_values([epoch_us, identity])
        out = []
        for at, number, bad, gone in zip(rows[epoch_us], rows[identity], rows[needs], rows[unavailable]):
            second = int(at) // MICROS
            if bad and not (gone and not failing) and second >= free_at:
                out.append((key[0], int(number), second))
                free_at = second + wait_seconds
            failing = bool(bad)
        state.update((failing, free_at))
        if out:
            yield pd.DataFrame(out, columns=[service, identity, "accepted_second"])

    return log.groupBy(service).applyInPandasWithState(
        step, f"{_types(log, [service, identity])}, accepted_second long", "failing boolean, free_at long", "append", GroupStateTimeout.NoTimeout)


def completion_stream(requests: DataFrame, completions: DataFrame, request: str, created: str, attempt: str, horizon: str,
                      watermark: str = "10 minutes") -> DataFrame:
    """Requests joined with completions of the same id that are not older than one second before
    them and not later than ``horizon``; both watermarks bound the state. A request can meet several
    completions; the earliest is the minimum of ``attempt`` per request downstream."""
    left = requests.withWatermark(created, watermark)
    right = completions.withColumnRenamed(request, "_request").withWatermark(attempt, watermark)
    rule = ((F.col(request) == F.col("_request")) & (F.col(attempt) >= F.col(created) - F.expr("INTERVAL 1 SECOND"))
            & (F.col(attempt) <= F.col(created) + F.expr(f"INTERVAL {horizon}")))
    return left.join(right, rule, "inner").drop("_request")


def dedupe_stream(observations: DataFrame, key: Sequence[str], at: str, watermark: str = "1 hour") -> DataFrame:
    """First observation per key; state is dropped behind the watermark."""
    return observations.withWatermark(at, watermark).dropDuplicatesWithinWatermark(list(key))


def window_stream(checks: DataFrame, at: str, failed: Column, width: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Checks and failures per nominal window, emitted when the watermark closes it."""
    return checks.withWatermark(at, watermark).groupBy(F.window(at, width).alias("w")).agg(
        F.count(F.lit(1)).alias("checks"), F.count_if(failed).alias("failed")).select(F.col("w.start").alias("start"), "checks", "failed")
