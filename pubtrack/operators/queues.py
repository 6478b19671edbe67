"""Work queues, budgets and backoff."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubtrack.operators.scan import last_known, ordered_scan, previous, rank, total


def queue_name(date: Column, since: Column) -> Column:
    """Recent, historical or undated work."""
    return F.when(date.isNull(), "undated").when(date < since, "historical").otherwise("recent")


def queue_sizes(items: DataFrame, queue: Column, open_item: Column) -> DataFrame:
    """Open items per queue; undated ones always count as open."""
    named = items.withColumn("queue", queue)
    return named.where(F.coalesce(open_item, F.lit(False)) | (F.col("queue") == "undated")).groupBy("queue").agg(
        F.count(F.lit(1)).alias("queue_size"))


def budget_work(items: DataFrame, queue: str, priority: Column, attempted: Column, date: Column, identity: str, budget: int,
                queue_caps: dict[str, int]) -> DataFrame:
    """Processing order over all queues and the verdict per item.

    Order: queue, priority, least recently attempted (never first), newest, id. A queue with a cap
    stops at it; the undated queue fills its cap by attempt and id alone. The overall budget counts only
    accepted items; everything else is deferred.
    """
    queue_order = F.when(F.col(queue) == "recent", 0).when(F.col(queue) == "historical", 1).otherwise(2)
    attempt_order = F.coalesce(attempted.cast("string"), F.lit(""))
    newest = -F.coalesce(F.unix_date(date), F.lit(0))
    order = [queue_order, priority, attempt_order, newest, F.col(identity)]
    undated = F.col(queue) == "undated"
    first = ordered_scan(items, [queue], [F.when(~undated, priority), attempt_order, F.when(~undated, newest), F.col(identity)], [rank("queue_position")])
    capped = F.lit(True)
    for name, cap in queue_caps.items():
        capped = capped & ((F.col(queue) != name) | (F.col("queue_position") <= cap))
    # An item beyond the cap of its queue uses no budget, so the running count skips it.
    scanned = ordered_scan(first.withColumn("_fits", capped), [], order,
                           [rank("work_order"), total("_used", F.col("_fits").cast("long"))], like=items)
    return scanned.withColumn("accepted", F.col("_fits") & (F.col("_used") <= budget)).drop("_fits", "_used")


def byte_budget(publications: DataFrame, scope: Sequence[str], identity: str, full: str, stub: str, oldest_first: Sequence[Column],
                protected: Column, budget: int) -> DataFrame:
    """Which publications keep their rows when a snapshot must fit a byte budget.

    The shortest prefix of the oldest unprotected ones is reduced to stubs; ``fits`` is false when
    even that is not enough.
    """
    gain = F.when(~protected, F.col(full) - F.col(stub)).otherwise(F.lit(0)).cast("long")
    sized = publications.withColumn("_gain", gain)
    totals = sized.groupBy(*scope).agg(F.sum(full).alias("_total"), F.sum("_gain").alias("_possible"))
    scanned = ordered_scan(sized, scope, [*oldest_first, F.col(identity)], [total("_freed", F.col("_gain"))])
    met = scanned.join(totals, list(scope))
    excess = F.col("_total") - budget
    reduced = ~protected & (F.col("_freed") - F.col("_gain") < excess)
    return met.withColumn("reduced", reduced).withColumn("fits", F.col("_possible") >= excess).drop(
        "_gain", "_total", "_possible", "_freed")


def failure_streaks(checks: DataFrame, resource: Sequence[str], order: Sequence[Column], failed: Column) -> DataFrame:
    """Consecutive failures since the last success at every check. The count is the running total
    of failures minus its value at the last success, so a long streak needs no grouping."""
    flagged = checks.withColumn("_failed", failed.cast("long"))
    counted = ordered_scan(flagged, resource, order, [total("_total", F.col("_failed"))], keep=True)
    based = ordered_scan(counted, resource, order, [last_known("_base", F.when(F.col("_failed") == 0, F.col("_total")))])
    return based.withColumn("failures", F.col("_total") - F.coalesce("_base", F.lit(0))).drop("_failed", "_total", "_base")


def backoff_seconds(failures: Column, retry_after: Column | None = None) -> Column:
    """Wait after consecutive failures: one hour doubled per failure up to five, at most six hours,
    never below what the server asked for."""
    steps = F.least(failures, F.lit(5))
    wait = F.least(F.lit(21600), F.lit(3600) * F.pow(F.lit(2), steps - 1)).cast("long")
    return F.when(failures > 0, wait if retry_after is None else F.greatest(wait, F.coalesce(retry_after, F.lit(0))))


def pruned_backoff(attempts: DataFrame, resource: Sequence[str], at: str, identity: str, failed: str, challenge: str, browser: str, retry_after: str,
                   keep_seconds: int = 7 * 86_400) -> DataFrame:
    """What becomes of every attempt on a resource (say, URL and kind) under its own cooldown: deferred, failed or read.

    A failure waits one hour, doubled per failure in a row up to five, at most six hours and at least ``retry_after``
    seconds (null: nothing). With ``browser``, a ``challenge`` counts for the browser only, and a challenge of the plain
    client does not hold the browser back. An attempt before the wait has passed is ``deferred`` and changes nothing. A
    success ends the waits of its transport (of both, if by browser). A failure more than ``keep_seconds`` after the
    wait of the one before is the first again. Columns: resource, identity, outcome, failures, next_attempt (seconds;
    both null unless failed). The walk over a sorted resource holds two entries.
    """
    names, types = list(resource), dict(attempts.dtypes)
    columns = [*names, identity, at, failed, challenge, browser, retry_after]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, entries = None, {}
        for batch in batches:
            rows = []
            floors = batch[retry_after].astype("Int64").tolist()
            for *key, number, now, bad, barred, by_browser, floor in zip(*[batch[c].tolist() for c in columns[:-1]], floors):
                if key != gate:
                    gate, entries = key, {}
                entries = {scope: e for scope, e in entries.items() if e[1] > now - keep_seconds}
                blocking = [e for scope, e in entries.items() if e[1] > now and (by_browser or not scope) and not (by_browser and not scope and e[2])]
                if blocking:
                    rows.append((*key, number, "deferred", None, None))
                elif not bad:
                    entries.pop(False, None)
                    if by_browser:
                        entries.pop(True, None)
                    rows.append((*key, number, "read", None, None))
                else:
                    scope = bool(by_browser and barred)
                    failures = min(5, entries.get(scope, (0,))[0] + 1)
                    until = now + max(0 if floor is pd.NA else floor, min(21_600, 3_600 * 2 ** (failures - 1)))
                    entries[scope] = (failures, until, bool(barred))
                    rows.append((*key, number, "failed", failures, until))
            yield pd.DataFrame(rows, columns=[*names, identity, "outcome", "failures", "next_attempt"]).astype({"failures": "Int64", "next_attempt": "Int64"})

    ordered = attempts.select(*dict.fromkeys(columns)).repartition(*names).sortWithinPartitions(*names, at, identity)
    return ordered.mapInPandas(walk, ", ".join(f"{c} {types[c]}" for c in [*names, identity]) + ", outcome string, failures long, next_attempt long")


def carry_state(observations: DataFrame, service: Sequence[str], order: Sequence[Column], bad: Column, at: str) -> DataFrame:
    """First failure of the running failing period and time of the last good observation."""
    marked = observations.withColumn("_bad", bad)
    lagged = ordered_scan(marked, service, order, [previous("_was_bad", F.col("_bad"))], keep=True)
    opens = F.col("_bad") & ~F.coalesce("_was_bad", F.lit(False))
    scanned = ordered_scan(lagged, service, order, [
        last_known("_opened", F.when(opens, F.col(at))), last_known("last_good", F.when(~F.col("_bad"), F.col(at)))])
    return scanned.withColumn("first_failure", F.when(F.col("_bad"), F.col("_opened"))).drop("_bad", "_was_bad", "_opened")


def pacing_violations(requests: DataFrame, host: Sequence[str], order: Sequence[Column], epoch: Column, seconds: float) -> DataFrame:
    """Requests sent earlier than the agreed interval after the one before."""
    timed = requests.withColumn("_at", epoch)
    scanned = ordered_scan(timed, host, order, [previous("_before", F.col("_at"))])
    gap = F.col("_at") - F.col("_before")
    return scanned.withColumn("gap", gap).where(F.col("gap") < seconds).drop("_at", "_before")


def feed_continuity(entries: DataFrame, feed: Sequence[str], page_order: Sequence[Column], date: str) -> DataFrame:
    """Entries dated later than the entry before them, where the feed must run from new to old."""
    scanned = ordered_scan(entries, feed, page_order, [previous("_date_before", F.col(date))])
    return scanned.where(F.col(date) > F.col("_date_before")).drop("_date_before")
