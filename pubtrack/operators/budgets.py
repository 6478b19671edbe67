"""Budgets that settle later than they admit, and a throttle whose single service is split over tasks.

Admission depends on everything admitted before, so a budget or a ledger is walked in order; Spark sorts the rows
and the walk holds what is open, never the rows. The throttle has no state beyond the last acceptance, so it is a
path over the seconds and can be followed by joins.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pubtrack.operators.ledger import DAY
from pubtrack.operators.scan import next_known, ordered_scan
from pubtrack.session import cut

DAY_US = DAY * 1_000_000


def delayed_budget(requests: DataFrame, scope: Sequence[str], identity: str, asked: str, estimate: str, settled: str, actual: str, budget: int,
                   most: int = 2000, overhead: int = 32) -> DataFrame:
    """Requests admitted under a daily budget that holds an estimate until its request settles.

    A day starts with its first request or with what a request of an earlier day leaves to it, whichever comes
    first; a request that starts a day is admitted, any other one if usage + estimate fits and fewer than ``most``
    were counted. ``settled`` (same clock as ``asked``, microseconds) replaces the estimate by ``actual`` +
    ``overhead`` (the estimate again if ``actual`` is null), never below zero; on a later day, that day is charged
    and counted as well. Settlements come before requests of the same instant, but not before the instant after their own
    request. A request without ``settled`` stays at its estimate. Columns: scope, identity, day (days since 1970), estimate, used (after admission).

    Estimates that are open wait in a priority queue by the time they settle, so each request is one sorted row.
    """
    names, types = list(scope), dict(requests.dtypes)
    columns = [*names, identity, asked, estimate, settled, actual]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, day, used, count, waiting = None, None, 0, 0, []
        for batch in batches:
            rows = []
            known = [batch[c].astype("Int64").tolist() for c in (settled, actual)]
            for *key, request, at, wish, end, cost in zip(*[batch[c].tolist() for c in [*names, identity, asked, estimate]], *known):
                if key != gate:
                    gate, day, used, count, waiting = key, None, 0, 0, []
                while waiting and waiting[0][0] <= at:
                    when, _, since, held, charge = heappop(waiting)
                    today = when // DAY_US
                    if today == since:
                        used = max(0, used - held + charge) if day == since else used
                    elif today == day:
                        used, count = used + charge, count + 1
                    else:
                        day, used, count = today, charge, 1
                today = at // DAY_US
                if today == day and not (used + wish <= budget and count < most):
                    continue
                used, count = (used + wish, count + 1) if today == day else (wish, 1)
                day = today
                if end is not pd.NA:
                    heappush(waiting, (max(end, at + 1), request, today, wish, wish if cost is pd.NA else cost + overhead))
                rows.append((*key, request, today, wish, used))
            yield pd.DataFrame(rows, columns=[*names, identity, "day", estimate, "used"])

    ordered = requests.select(*dict.fromkeys(columns)).repartition(*names).sortWithinPartitions(*names, asked, identity)
    return ordered.mapInPandas(walk, ", ".join(f"{c} {types[c]}" for c in [*names, identity]) + f", day long, {estimate} {types[estimate]}, used long")


@dataclass
class WriteLedger:
    """One ledger of writes with a limit per day: what today is charged, what open reservations of earlier days
    still count today, and the open reservations (identity: day, reserved, end of the lease)."""

    limit: int
    overhead: int
    keep_days: int
    day: int = -1
    charged: int = 0
    carried: int = 0
    open: dict[int, tuple[int, int, int]] = field(default_factory=dict)

    def turn(self, day: int) -> None:
        """Midnight: earlier reservations whose lease reaches into ``day`` are carried over; those past the retention go."""
        if day <= self.day:
            return
        self.day, self.charged = day, 0
        self.open = {i: r for i, r in self.open.items() if r[2] // DAY_US + self.keep_days >= day}
        self.carried = sum(r[1] for r in self.open.values() if r[0] < day <= r[2] // DAY_US)

    def reserve(self, identity: int, at: int, wish: int, lease_us: int) -> tuple[str, int, int, int]:
        """(outcome, day, reserved, usage of the day afterwards)."""
        day = at // DAY_US
        self.turn(day)
        used = self.charged + self.carried
        if used + wish > self.limit:
            return "refused", day, wish, used
        self.charged += wish
        self.open[identity] = (day, wish, at + lease_us)
        return "admitted", day, wish, used + wish

    def settle(self, identity: int, at: int, written: int | None) -> list[tuple[str, int, int, int]]:
        """What each day is charged for the reservation from now on; nothing if it is not open."""
        today = at // DAY_US
        self.turn(today)
        if identity not in self.open:
            return []
        day, reserved, end = self.open.pop(identity)
        measured = reserved if written is None else written + self.overhead
        expired = at >= end
        actual = max(reserved, measured) if expired else measured
        last = end // DAY_US if expired else today
        entries = {day: actual} | ({last: actual} if day < last else {}) | ({today: self.overhead} if today > last else {})
        self.charged += entries.get(today, 0) - (reserved if day == today else 0)
        self.carried -= reserved if day < today <= end // DAY_US else 0
        used = self.charged + self.carried
        return [("charged", d, n, used) for d, n in entries.items()]


LEDGER_COLUMNS = "outcome string, day long, amount long, used long"


def write_ledger(log: DataFrame, ledger: str, at: str, identity: str, reserved: str, written: str, limit: int, lease_us: int, overhead: int = 8,
                 keep_days: int = 7) -> DataFrame:
    """Every decision of daily write ledgers over a log of reservations (``reserved`` set) and settlements (null).

    A reservation is admitted if charges of its day + open reservations of earlier days whose lease reaches into it +
    itself stay within ``limit``, and is charged at once. A settlement replaces the charge by ``written`` +
    ``overhead`` (by the reservation if ``written`` is null); once the lease has ended at least the reservation
    counts, a later day within the lease is charged as well, and a settlement after the day of the lease's end
    charges ``overhead`` to its own day. A reservation that never settles is forgotten ``keep_days`` after its
    lease; settlements of what is not open have no effect. At one instant settlements come first.
    Columns: ledger, identity, outcome (admitted, refused, charged), day (since 1970), amount, used.
    """
    types = dict(log.dtypes)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        gate, book = None, None
        for batch in batches:
            rows = []
            known = [batch[c].astype("Int64").tolist() for c in (reserved, written)]
            for key, request, when, wish, cost in zip(batch[ledger].tolist(), batch[identity].tolist(), batch[at].tolist(), *known):
                if book is None or key != gate:
                    gate, book = key, WriteLedger(limit, overhead, keep_days)
                found = book.settle(request, when, None if cost is pd.NA else cost) if wish is pd.NA else [book.reserve(request, when, wish, lease_us)]
                rows += [(key, request, *f) for f in found]
            yield pd.DataFrame(rows, columns=[ledger, identity, "outcome", "day", "amount", "used"])

    ordered = log.select(ledger, identity, at, reserved, written).repartition(ledger).sortWithinPartitions(ledger, at, F.col(reserved).isNotNull(), identity)
    return ordered.mapInPandas(walk, f"{ledger} {types[ledger]}, {identity} {types[identity]}, {LEDGER_COLUMNS}")


def split_throttle(requests: DataFrame, service: Sequence[str], identity: str, seconds: Column, gap: int, per_day: int) -> DataFrame:
    """Accepted requests of a single-flight service, as :func:`pubtrack.operators.ledger.throttle` gives them, without
    a task that walks a service.

    Every second points to the first later one that may be accepted after it. Squaring these pointers gives jumps of
    2, 4, 8 ... acceptances within a day; they find the day's last acceptance from each second a day can begin
    with, hence the second the next day begins with. Squaring those pointers and following them from the first second
    on gives every day's begin, and the jumps from there all acceptances. Each step joins on (service, second), so
    one busy service is spread over all tasks; the number of steps is logarithmic in the days and in ``per_day``.
    """
    names = list(service)
    node = [*names, "s"]
    nodes = requests.withColumn("s", seconds.cast("long")).groupBy(*names, "s").agg(F.min(identity).alias(identity))
    day = F.floor(F.col("s") / DAY)

    def first_from(starts: DataFrame, limit: Column) -> DataFrame:
        """``starts`` with ``to``: the first second of the service not before ``limit`` (one ordered merge)."""
        asked = starts.select(*node, limit.alias("t"), F.lit(0).alias("kind"))
        there = nodes.select(*names, F.lit(None).cast("long").alias("s"), F.col("s").alias("t"), F.lit(1).alias("kind"))
        found = ordered_scan(asked.unionByName(there), names, [F.col("t"), F.col("kind"), F.col("s")], [next_known("to", F.when(F.col("kind") == 1, F.col("t")))])
        return found.where("kind = 0 AND to IS NOT NULL").select(*node, "to")

    def squared(jump: DataFrame) -> DataFrame:
        onward = jump.select(*names, F.col("s").alias("to"), F.col("to").alias("further"))
        return jump.join(onward, [*names, "to"]).select(*node, F.col("further").alias("to"))

    jumps = [first_from(nodes, F.col("s") + gap).where(F.floor(F.col("to") / DAY) == day).transform(cut)]
    while 2 ** len(jumps) < min(per_day, DAY // max(gap, 1) + 1):
        jumps.append(cut(squared(jumps[-1])))

    # A day can begin with a second that the day before reaches by its gap, or with the first one after these.
    early = nodes.where(F.col("s") % DAY < gap).select(*node)
    after = nodes.where(F.col("s") % DAY >= gap).groupBy(*names, day.alias("_d")).agg(F.min("s").alias("s")).select(*node)
    lasts = cut(early.unionByName(after)).withColumns({"last": F.col("s"), "left": F.lit(per_day - 1).cast("long")})
    for k in range(len(jumps) - 1, -1, -1):
        step = jumps[k].select(*names, F.col("s").alias("last"), F.col("to").alias("_to"))
        goes = F.col("_to").isNotNull() & (F.col("left") >= 2**k)
        lasts = lasts.join(step, [*names, "last"], "left").select(*node, F.when(goes, F.col("_to")).otherwise(F.col("last")).alias("last"),
                                                                  F.when(goes, F.col("left") - 2**k).otherwise(F.col("left")).alias("left"))
    lasts = cut(lasts)
    following = first_from(lasts.select(*names, F.col("last").alias("s"), "left"), F.greatest(F.col("s") + gap, (day + 1) * DAY)).distinct()
    begins = cut(lasts.join(following.select(*names, F.col("s").alias("last"), "to"), [*names, "last"]).select(*node, "to"))
    paths = [begins]
    days = nodes.agg(F.countDistinct(day)).first()[0]
    while 2 ** len(paths) < days:
        paths.append(cut(squared(paths[-1])))

    def spread(held: DataFrame, steps: list[DataFrame], count: Column | None) -> DataFrame:
        """All that ``held`` reaches: each number of steps is one sum of powers of two, so nothing is met twice."""
        for k in range(len(steps) - 1, -1, -1):
            moved = held.join(steps[k], node).select(*names, F.col("to").alias("s"), (F.col("n") + 2**k).alias("n"))
            held = cut(held.unionByName(moved if count is None else moved.where(count)))
        return held

    first = nodes.groupBy(*names).agg(F.min("s").alias("s")).withColumn("n", F.lit(0).cast("long"))
    entered = spread(first, paths, None).select(*node, F.lit(0).cast("long").alias("n"))
    accepted = spread(entered, jumps, F.col("n") < per_day)
    return nodes.join(accepted.select(*node), node).select(*names, F.col("s").alias("accepted_second"), identity)
